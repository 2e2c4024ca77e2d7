from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuro.operators import models as M
from murmuro.operators.metrics import summary_text
from murmuro.operators.segments import ingest, parse_transcripts, slice_codes
from murmuro.plans import forms
from murmuro.sources import audio, checkpoints, tables, tars


def test_wave_files(spark, tmp_path):
    left, right = np.sin(np.arange(800) / 9).astype(np.float32), np.zeros(800, np.float32)
    for name, samples in (("a", np.stack([left, right])), ("b", left[:, None])):
        (tmp_path / f"{name}.wav").write_bytes(audio.encode(samples, 16_000))
    got = {(r["path"].rsplit("/", 1)[-1], r["channel"]): r for r in audio.read_wav(spark, str(tmp_path)).collect()}
    assert set(got) == {("a.wav", 0), ("a.wav", 1), ("b.wav", 0)}
    assert np.allclose(got["a.wav", 0]["samples"], left, atol=1e-3) and got["b.wav", 0]["sample_rate"] == 16_000
    rows = spark.createDataFrame([("turn_000_spk1", 8000, [0.0, 0.5, 2.0])], "name string, sample_rate int, samples array<float>")
    assert audio.write_wav(rows, f"{tmp_path}/out").collect()[0]["n_samples"] == 3
    assert audio.decode((tmp_path / "out" / "turn_000_spk1.wav").read_bytes())[0][0][2] == pytest.approx(1, abs=1e-3)


def test_tar_shards(spark, tmp_path):
    rows = [(f"{i:08d}_00000", [[0.5, float(i)]] * (i % 3 + 1), [[40_000, i]] * (i % 3 + 1), json.dumps({"row": i}), i) for i in range(23)]
    df = spark.createDataFrame(rows, "key string, hiddens array<array<float>>, targets array<array<int>>, meta string, place long")
    index = tars.write_tars(df, str(tmp_path), "m_train", 10)
    found = sorted((r["shard"], r["num_samples"], r["total_frames"]) for r in index.collect())
    assert [f[:2] for f in found] == [("m_train_00000.tar", 10), ("m_train_00001.tar", 10), ("m_train_00002.tar", 3)]
    back = {r["key"]: r for r in tars.read_tars(spark, str(tmp_path)).collect()}
    assert {k: (r["hiddens"], r["targets"]) for k, r in back.items()} == {k: (h, t) for k, h, t, _, _ in rows}
    assert json.loads(back["00000004_00000"]["meta"]) == {"row": 4}
    assert tars.shard_urls(str(tmp_path), "m_train").endswith("m_train_{00000..00002}.tar")
    (tmp_path / "m_train_00001.tar").unlink()
    with pytest.raises(FileNotFoundError):
        tars.shard_urls(str(tmp_path), "m_train")


def test_checkpoint_tensors(spark, tmp_path):
    tensors = {"decoder.norm.scale": np.arange(4, dtype="<f4"), "audio_head": np.arange(12, dtype="<f4").reshape(3, 4), "other": np.zeros(2, "<f4")}
    head, data = {}, b""
    for k, v in tensors.items():
        head[k] = {"dtype": "F32", "shape": list(v.shape), "data_offsets": [len(data), len(data) + v.nbytes]}
        data += v.tobytes()
    text = json.dumps(head).encode()
    path = tmp_path / "c.safetensors"
    path.write_bytes(struct.pack("<Q", len(text)) + text + data)
    wanted = spark.createDataFrame([("audio_head", "audio_head"), ("decoder.norm.scale", "decoder.norm.weight")], "source string, target string")
    got = checkpoints.renamed(checkpoints.read_tensors(spark, str(path), wanted), wanted).collect()
    assert sorted((r["key"], r["row"], list(r["vector"])) for r in got) == [("audio_head", i, [4.0 * i + j for j in range(4)]) for i in range(3)] + [("decoder.norm.weight", i, [float(i)]) for i in range(4)]
    with pytest.raises(KeyError, match="audio_embeddings"):
        checkpoints.read_tensors(spark, str(path), checkpoints.key_names(spark))
    assert checkpoints.key_names(spark, 8).count() == 4 + 9 * 8


def test_rotary_rows_are_a_bijection_within_heads(spark):
    from murmuro.functions.scalars import rope_row

    got = [r[0] for r in spark.range(24).select(rope_row(F.col("id"), F.lit(8))).collect()]
    assert got[:8] == [0, 4, 1, 5, 2, 6, 3, 7] and sorted(got) == list(range(24)) and all(a // 8 == i // 8 for i, a in enumerate(got))


def test_transcripts(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"dataset": "d", "split": "s", "row": 3, "sample_rate": 8000, "num_channels": 1, "duration_sec": 9.5, "segments": [{"segment_id": 0, "start": 0.5, "end": 2, "channel": 0, "text": "hi"}]}))
    row = tables.read_transcripts(spark, str(tmp_path / "t.json")).collect()[0]
    assert (row["source_dataset_id"], row["speaker"], row["start_sec"], row["end_sec"]) == (3, "speaker", 0.5, 2.0)
    rows = [(1, '[{"start": 1, "end": 2, "text": "a"}, {"start_time_ms": 5, "end_time_ms": 5}]', None), (2, None, '{"turns": [{"end": 1.5, "channel": 1, "speaker": "z"}]}'), (3, "no json", None), (4, None, None), (5, "[]", None)]
    got = parse_transcripts(spark.createDataFrame(rows, "row int, json string, transcript string"), ["row"]).collect()
    assert sorted((r["row"], r["segment_id"], r["channel"], r["speaker"], r["text"], r["start_sec"], r["end_sec"], r["valid"]) for r in got) == [
        (1, 0, 0, "speaker", "a", 1.0, 2.0, True), (1, 1, 0, "speaker", "", 0.005, 0.005, False), (2, 0, 1, "z", "", 0.0, 1.5, True),
    ]


def test_ingest(spark):
    rows = [(1, 8000, 1, 10.0, '[{"start": 0, "end": 2}, {"start": 3, "end": 3}, {"start": 0, "end": 11}, {"start": 0, "end": 1, "channel": 1}]'), (2, 8000, 1, 10.0, "none"), (3, None, None, None, '{"turns": [{"start": 0, "end": 99}]}')]
    good, bad = ingest(spark.createDataFrame(rows, "row int, sample_rate int, num_channels int, duration_sec double, transcript string"))
    assert sorted((r["row"], r["segment_id"]) for r in good.collect()) == [(1, 0), (3, 0)]
    assert sorted((r["row"], r["segment_id"] or 0, r["reason"]) for r in bad.collect()) == [(1, 1, "reversed"), (1, 2, "late"), (1, 3, "channel"), (2, 0, "no transcript")]


def test_prompts_scripts_and_rows(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"text": "one"}\n\n  \n{"text": "two"}\n')
    assert [r["text"] for r in tables.read_prompts(spark, str(tmp_path / "p.jsonl")).collect()] == ["one", "two"]
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("segments:\n  - {text: ' hello '}\n  - {speaker: 1, text: x}\n")
    assert [tuple(r) for r in tables.read_script(spark, str(tmp_path / "s.yaml")).collect()] == [(0, 0, "hello"), (1, 1, "x")]
    (tmp_path / "bad.yaml").write_text("segments:\n  - {speaker: 2, text: x}\n")
    with pytest.raises(ValueError):
        tables.read_script(spark, str(tmp_path / "bad.yaml"))
    df = spark.range(10).withColumnRenamed("id", "row")
    assert [r["row"] for r in tables.select_rows(df, [7, 2]).collect()] == [2, 7]
    for wrong in ([], [-1]):
        with pytest.raises(ValueError):
            tables.select_rows(df, wrong)
    assert sorted(r["row"] for r in tables.missing(spark.createDataFrame([(3,), (30,), (31,)], "row long"), df, "row").collect()) == [30, 31]
    with pytest.raises(ValueError):
        tables.row_count(df.limit(0))
    for name in ("b", "a", "c"):
        (tmp_path / f"ck-{name}").mkdir()
    assert tables.last_checkpoint(spark, f"{tmp_path}/ck-*").endswith("ck-c")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d", "m", 4), ("d", "n", 5)], "dataset string, model string, num_codebooks int")
    tables.write_sequences(df, f"{tmp_path}/seq", ["num_codebooks"])
    assert spark.read.parquet(f"{tmp_path}/seq").where("model = 'm'").count() == 1
    with pytest.raises(ValueError):
        tables.write_sequences(df.withColumn("model", F.lit("m")), f"{tmp_path}/no", ["num_codebooks"])
    for _ in range(2):
        tables.write_failures(df.limit(1), f"{tmp_path}/fail")
    assert spark.read.json(f"{tmp_path}/fail").count() == 2
    info = spark.createDataFrame([('{"total_train_frames": 12}',), ("{}",), ("no",), (None,)], "i string").select(tables.expected_frames("i", "train").alias("n"))
    assert [r["n"] for r in info.collect()] == [12, None, None, None]


def test_backend_and_cache(spark):
    backend = M.ToyBackend(vocabulary=5)
    df = spark.createDataFrame([("a", 3), ("b", 0), ("c", None), ("d", 2500)], "key string, frames int")
    first, again = M.featurized(df, "key", "frames", backend), M.featurized(df.repartition(3), "key", "frames", backend)
    assert first.count() == 2503
    assert first.exceptAll(again).count() == 0
    row = first.first()
    assert len(row["logits"]) == len(row["targets"]) == 4 and all(len(h) == 5 for h in row["logits"])
    cache = np.arange(2 * 2 * 1 * 3 * 7 * 4).reshape(2, 2, 1, 3, 7, 4)
    assert M.audio_cache(cache, 2, 5).shape == (3, 2, 2, 3, 4) and (M.audio_cache(cache, 2, 5)[0, 1, 0] == cache[1, 0, 0, :, 1]).all()
    assert M.audio_cache(cache, 0, 5) is None and M.audio_cache(cache, 2, 99) is None


def test_pipeline_takes_recordings_of_any_length(spark, tmp_path):
    rows = [(1, 10.0), (2, 200.0), (2, 90.0), (3, float("nan")), (4, float("inf")), (5, 0.0), (6, -3.0), (7, None)]
    spark.createDataFrame(rows, "row_id long, duration_sec double").write.parquet(f"{tmp_path}/raw_rows.parquet")
    backend, parts = M.ToyBackend(), []
    for key, n in (("1/0", 125), ("2/0", 1024), ("2/1024", 1024), ("2/2048", 452)):
        codes = backend.audio_codes(key, n)
        x = backend.logits(key, codes)
        parts.append(np.log(np.exp(x).sum(-1)) - np.take_along_axis(x, codes[..., None], 2)[..., 0])
    nll = np.concatenate(parts)
    got = {r["scope"]: r["avg_nll"] for r in forms.toy_pipeline_e2e(spark, str(tmp_path)).collect()}
    assert got == pytest.approx({"semantic": nll[:, 0].mean(), "audio": nll[:, 1:].mean(), "total": nll.mean()}, abs=2e-6)


def test_trend_follows_a_line(spark):
    df = spark.range(500).selectExpr("'g' as g", "cast(id as double) as x", "3.0 * id + 1 as y")
    got = M.loess(df, ["g"], "x", "y").collect()
    assert len(got) == 500 and all(abs(r["trend"] - (3 * r["x"] + 1)) < 1e-6 for r in got)


def test_sliced_codes(spark):
    bounds = spark.createDataFrame([(1, 0, 9, 2, 5)], "row int, channel int, segment_id int, frame_start long, frame_end long")
    codes = spark.createDataFrame([(1, 0, list(range(10))), (1, 1, [0])], "row int, channel int, codes array<int>")
    assert [list(r["codes"]) for r in slice_codes(bounds, codes, "row", "channel").collect()] == [[2, 3, 4]]


def test_summary_text():
    assert summary_text([["miso", "2.429"]], ["Model", "kbit/s"]) == "| Model | kbit/s |\n|-------|-------:|\n| miso  |  2.429 |\n"
