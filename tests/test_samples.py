from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from murmuro.functions import logits as L
from murmuro.operators import models as M
from murmuro.operators import samples as A
from murmuro.operators.metrics import audio_frame_metrics
from murmuro.sources import audio, files, tables, tars
from murmuro.streaming.chunks import pack_frames

SPANS = f"array<{A.SPAN}>"
TOKENS = f"model string, row_id long, seq_id int, tokens array<array<int>>, mask array<array<boolean>>, spans {SPANS}, layout {A.LAYOUT}"
FEATURES = "model string, row_id long, seq_id int, hiddens array<array<float>>, logits array<array<array<float>>>"
LAYOUT = (2, -1, None, None, None)


def grid(n, audio_at):
    """Text rows with audio rows in [a, b)."""
    rows = [([10 * p, 10 * p + 1, 0], [True, True, False]) if any(a <= p < b for a, b in audio_at) else ([0, 0, p + 1], [False, False, True]) for p in range(n)]
    return [r[0] for r in rows], [r[1] for r in rows]


def sequence(seq, n, audio_at, layout=LAYOUT, **change):
    tokens, mask = grid(n, audio_at)
    spans = change.get("spans", [(7, seq, a, b, "audio") for a, b in audio_at] + [(7, seq, 0, 1, "text")])
    return ("m", 1, seq, change.get("tokens", tokens), change.get("mask", mask), spans, layout)


def features(seq, n, heads=1, head_n=None):
    return ("m", 1, seq, [[float(p), 0.5] for p in range(n)], [[[1.0, 2.0]] * (n if head_n is None else head_n)] * heads)


def test_samples_and_why_there_are_none(spark):
    good = sequence(0, 6, [(2, 5)])
    rows = [
        good, sequence(1, 6, [(2, 5)]), sequence(2, 6, []), sequence(3, 6, [(1, 2), (3, 5)]), sequence(4, 6, [(0, 3)]), sequence(5, 6, [(2, 5)]), sequence(6, 6, [(2, 5)]),
        sequence(7, 6, [(2, 5)], spans=[(7, 7, 2, 9, "audio")]), sequence(8, 6, [(2, 5)], layout=(3, -1, [0, 1], None, None)), sequence(9, 6, [(2, 5)], mask=[[False, False, False]] * 6), sequence(10, 6, [(2, 5)], layout=(2, 0, [0, 2], None, None), tokens=[[p, p, p] for p in range(6)], mask=[[True] * 3] * 6),
        sequence(11, 6, [(2, 5)], layout=None), sequence(12, 0, [], spans=[]),
    ]
    feats = [features(i, 5) for i in (0, 2, 3, 4, 7, 8, 9, 10, 11)] + [features(5, 6), features(6, 5, 2, 4), features(20, 5)]
    t, f = spark.createDataFrame(rows, TOKENS), spark.createDataFrame(feats, FEATURES)
    ok, bad = A.row_samples(t.withColumn("extra", F.lit(1)), f.withColumn("extra", F.lit(2)), F.lit(12.5))
    got = {r["seq_id"]: r for r in ok.collect()}
    assert set(got) == {0, 10}
    assert got[0]["key"] == "00000001_00000" and got[0]["hiddens"] == [[1.0, 0.5], [2.0, 0.5], [3.0, 0.5]] and got[0]["targets"] == [[20, 21], [30, 31], [40, 41]]
    assert got[10]["targets"] == [[2, 2], [3, 3], [4, 4]]
    meta = json.loads(got[0]["meta"])
    assert meta == {"model": "m", "row_id": 1, "seq_id": 0, "source_dataset_id": 7, "segment_id": 0, "audio_frames": 3, "frame_rate": 12.5, "hidden_dim": 2, "num_codebooks": 2}
    assert {r["seq_id"]: r["reason"] for r in bad.collect()} == {1: "not featurized", 2: "no audio", 3: "several audio", 4: "first", 5: "length", 6: "head", 7: "span", 8: "layout", 9: "text", 11: "layout", 12: "not featurized", 20: "not tokenized"}
    _, bad = A.row_samples(t, f, F.lit(12.5), semantic=(20, 30))
    assert {r["seq_id"] for r in bad.where("reason = 'semantic'").collect()} == {0, 10}
    first_k = A.row_samples(spark.createDataFrame([sequence(0, 6, [(2, 5)], layout=(2, -1, [1, 0], None, None))], TOKENS), f, F.lit(12.5), first_k=True)[0].first()
    assert first_k["targets"] == [[20, 21], [30, 31], [40, 41]]
    empty = A.row_samples(t.limit(0), f.limit(0), F.lit(12.5))
    assert empty[0].count() == empty[1].count() == 0


def test_spans_and_layouts_in_json(spark):
    texts = ['{"source_dataset_id": 1, "segment_id": 2, "start": 3, "end": 4, "kind": "audio"}', '{"start": 3, "end": 4, "kind": "video"}', '{"start": 3, "kind": "text"}', "no", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(A.span_of(F.col("t"))).collect()]
    assert tuple(got[0]) == (1, 2, 3, 4, "audio") and got[1:] == [None] * 4
    texts = ['{"num_codebooks": 3, "text_channel": 0}', '{"num_codebooks": 2, "text_channel": -1, "head_targets": [0, 5]}', '{"num_codebooks": 2, "text_channel": -1, "head_targets": [1], "hidden_dim": 8, "logit_dims": [4, 4]}', '{"text_channel": 1}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(A.layout_of(F.col("t")).alias("l")).select("l", A.layout_reason(F.col("l")).alias("r")).collect()
    assert [r["r"] for r in rows] == ["ok", "column", "heads", "missing"]
    assert rows[0]["l"]["head_targets"] == [1, 2, 3] and rows[2]["l"]["logit_dims"] == [4, 4] and rows[3]["l"] is None


def test_segments_keep_their_place_without_codes(spark):
    bounds = spark.createDataFrame([(1, 0, 0, 1, 3), (1, 1, 1, 0, 2), (1, 0, 2, 9, 12), (2, 0, 3, 0, 1), (1, 0, 4, 3, 9)], "row int, channel int, segment int, frame_start long, frame_end long")
    codes = spark.createDataFrame([(1, 0, [0, 1, 2, 3, 4])], "row int, channel int, codes array<int>")
    got = {r["segment"]: r["codes"] for r in A.codes_of_segments(bounds, codes, "row", "channel").collect()}
    assert got == {0: [1, 2], 1: None, 2: None, 3: None, 4: [3, 4]}


def test_batches_hold_each_frame_once_in_order(spark):
    samples = spark.createDataFrame([("a", 5, [[float(i)] for i in range(5)], [[i] for i in range(5)]), ("a", 12, [[float(i)] for i in range(5, 12)], [[i] for i in range(5, 12)]), ("b", 4, [[0.0]] * 4, [[1]] * 4), ("b", 4, [], [])], "k string, end long, hiddens array<array<float>>, targets array<array<int>>")
    got = {(r["k"], r["batch_no"]): [t[0] for t in r["targets"]] for r in A.packed_frames(samples, ["k"], "end", 4).collect()}
    assert got == {("a", 0): [0, 1, 2, 3], ("a", 1): [4, 5, 6, 7], ("a", 2): [8, 9, 10, 11], ("b", 0): [1] * 4}
    assert A.packed_frames(samples, ["k"], "end", 5, drop_last=True).count() == 2


def test_usable_segments_need_text_and_audio(spark):
    rows = [("m", 1, 0, 5, 0, "text", 0, 2), ("m", 1, 0, 5, 0, "audio", 2, 4), ("m", 1, 0, 5, 0, "audio", 6, 9), ("m", 1, 0, 5, 1, "text", 4, 6), ("m", 1, 0, 5, 2, "audio", 9, 9), ("m", 1, 0, 5, 2, "text", 9, 10), ("m", 1, 0, 5, None, "text", 0, 1), ("m", 1, 0, 6, 1, "audio", 4, 6)]
    df = spark.createDataFrame(rows, "model string, row_id long, seq_id int, source_dataset_id long, segment_id int, kind string, span_start int, span_end int")
    assert [tuple(r)[4:] for r in A.usable_segments(df).collect()] == [(0, 0, 2, 6, 9)]


# ------------------------------------------------------------------ sound


def slowly(x, up, down, half, beta):
    most = max(up, down)
    t = np.arange(-half * most, half * most + 1)
    taps = np.sinc(t / most) * np.kaiser(len(t), beta)
    taps *= up / taps.sum()
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    full = np.convolve(wide, taps)[half * most :]
    return full[: len(x) * up][::down]


@pytest.mark.parametrize(("a", "b"), [(48_000, 24_000), (16_000, 24_000), (44_100, 16_000), (8000, 8000), (3, 7)])
def test_resampling_against_the_plain_sum(a, b):
    x = np.random.default_rng(0).normal(size=400)
    g = np.gcd(a, b)
    got = audio.resample(x, a, b)
    if a == b:
        assert np.allclose(got, x, atol=1e-6)
    else:
        want = slowly(x, b // g, a // g, audio.HALF_LENGTH, audio.BETA)
        assert len(got) == -(-len(x) * b // a) and np.allclose(got, want, atol=1e-5)


def test_a_tone_stays_a_tone_and_nulls_stay_null(spark):
    tone = np.sin(2 * np.pi * 440 * np.arange(48_000) / 48_000)
    got = audio.resample(tone, 48_000, 24_000)
    assert np.allclose(got[100:-100], np.sin(2 * np.pi * 440 * np.arange(24_000) / 24_000)[100:-100], atol=5e-3)
    df = spark.createDataFrame([([0.0] * 10, 4), (None, 4), ([1.0], 0), ([], 4)], "s array<float>, r int")
    assert [None if r[0] is None else len(r[0]) for r in df.select(audio.resampled_to(F.col("s"), F.col("r"), 2)).collect()] == [5, None, None, 0]


def test_payloads_of_all_kinds_and_their_segments(spark, tmp_path):
    wave = audio.encode(np.stack([np.full(8, 0.25), np.full(8, -0.5)]), 4)
    (tmp_path / "x y.wav").write_bytes(wave)
    rows = [(1, (wave, None, None, None)), (2, (None, f"{tmp_path}/x y.wav", None, None)), (3, (None, None, [[0.0, 1.0]] * 8, 4)), (4, (None, None, [[0.5] * 8], 4)), (5, (None, None, None, None))]
    df = spark.createDataFrame(rows, "row int, audio struct<bytes: binary, path: string, array: array<array<float>>, sampling_rate: int>")
    got = {(r["row"], r["channel"]): r for r in audio.decoded_payloads(df, ["row"]).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0), (5, None)}
    assert got[2, 1]["samples"] == pytest.approx([-0.5] * 8, abs=1e-3) and got[3, 1]["samples"] == [1.0] * 8 and got[5, None]["samples"] is None and got[4, 0]["sample_rate"] == 4
    clips = audio.decoded_payloads(df, ["row"]).where("samples is not null")
    s = spark.createDataFrame([(3, 1, 0.5, 1.0), (3, 1, 1.5, 9.0), (3, 2, 0.0, 1.0), (9, 0, 0.0, 1.0), (3, 0, 7.0, 8.0)], "row int, source_audio_channel_id int, start_sec double, end_sec double")
    assert [None if r["samples"] is None else len(r["samples"]) for r in audio.with_audio(s, clips, "row").orderBy("row", "source_audio_channel_id", "start_sec").collect()] == [None, 2, 2, None, None]


# ------------------------------------------------------------------ sinks


def test_caches_of_an_earlier_run_go(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, 0, 5, [1.0]), ("m", 1, 1, 5, None)], "model string, row_id long, seq_id int, layout int, kv_cache array<double>")
    path = f"{tmp_path}/f"
    assert tables.write_features(df, path, ["layout"])
    assert {r["seq_id"]: r["kv_cache"] for r in tables.load_sequences(spark, f"{path}/features", f"{path}/caches").collect()} == {0: [1.0], 1: None}
    assert not tables.write_features(df.withColumn("kv_cache", F.lit(None).cast("array<double>")), path, ["layout"])
    assert not (tmp_path / "f" / "caches").exists()
    with pytest.raises(ValueError, match="share one layout"):
        tables.write_features(df.withColumn("layout", F.col("seq_id")), path, ["layout"])


def test_codebooks_reports_and_shard_descriptions(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, [[1, 2], [3, 4]])], "row int, channel int, codes array<array<int>>")
    tables.write_codebooks(df, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").first()["num_codebooks"] == 2
    with pytest.raises(Exception, match="differ"):
        tables.write_codebooks(spark.createDataFrame([(1, 0, [[1, 2], [3]])], df.schema), f"{tmp_path}/d")
    tables.write_report(spark.range(1).selectExpr("id as frames", "array(1.5, 2.5) as nll"), f"{tmp_path}/r/report.json")
    assert json.loads((tmp_path / "r" / "report.json").read_text()) == {"frames": 0, "nll": [1.5, 2.5]}
    with pytest.raises(ValueError, match="one row"):
        tables.write_report(spark.range(2), f"{tmp_path}/r/no.json")
    tars.write_info(spark.createDataFrame([("b", 2, 5), ("a", 1, 7)], "shard string, num_samples long, total_frames long"), f"{tmp_path}/i.json", 4, 2)
    info = json.loads((tmp_path / "i.json").read_text())
    assert [s["shard"] for s in info["shards"]] == ["a", "b"] and (info["num_samples"], info["total_frames"], info["hidden_dim"], info["num_codebooks"]) == (3, 12, 4, 2)


def test_files_by_uri(tmp_path):
    with files.written(f"file:{tmp_path}/a b/c%20.txt") as f:
        f.write(b"x")
    assert files.read(f"{tmp_path}/a b/c%20.txt") == b"x" and files.names(f"file://{tmp_path}/a b", ".txt") == ["c%20.txt"] and files.names(f"{tmp_path}/none", "") == []
    with pytest.raises(ZeroDivisionError), files.written(f"{tmp_path}/half") as f:
        f.write(b"y")
        1 / 0
    assert not (tmp_path / "half").exists()


# ------------------------------------------------------------------ shards as a stream


@pytest.fixture
def shards(spark, tmp_path):
    rows = [(f"{i:08d}_00000", [[float(i)]] * (i % 3 + 1), [[i, k] for k in range(i % 3 + 1)], "{}", i) for i in range(24)]
    df = spark.createDataFrame(rows, "key string, hiddens array<array<float>>, targets array<array<int>>, meta string, place long")
    tars.write_tars(df, f"{tmp_path}/t", "m", 4).collect()
    return f"{tmp_path}/t"


def streamed(spark, df, name, batches):
    """What a stream gives in so many micro-batches."""
    found = []
    query = df.writeStream.foreachBatch(lambda b, i: found.append((i, b.collect()))).trigger(processingTime="0 seconds").start()
    try:
        while len([b for _, b in found if b]) < batches and query.isActive:
            query.awaitTermination(0.2)
    finally:
        query.stop()
    return [r for i, b in found for r in b]


def test_a_pass_and_an_endless_stream(spark, shards):
    once = streamed(spark, tars.stream_tars(spark, shards, seed=3, per_batch=4), "once", 2)
    assert sorted(r["key"] for r in once) == [f"{i:08d}_00000" for i in range(24)]
    order = [s for s, _ in sorted({(r["shard"], r["draw"]) for r in once}, key=lambda x: x[1])]
    assert order != sorted(order) and len(order) == 6
    many = streamed(spark, tars.stream_tars(spark, shards, seed=3, per_batch=5, resampled=True), "many", 3)
    drawn = {r["draw"]: r["shard"] for r in many}
    assert len(drawn) >= 15 and len(set(drawn.values())) < len(drawn)
    again = streamed(spark, tars.stream_tars(spark, shards, seed=3, per_batch=5, resampled=True), "again", 1)
    assert {r["draw"]: r["shard"] for r in again}.items() <= {**{r["draw"]: r["shard"] for r in again}, **drawn}.items()


def test_frames_are_carried_over(spark, tmp_path):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    schema = "lane string, place long, hiddens array<array<float>>, targets array<array<int>>, final boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = pack_frames(stream, "lane", 4).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
    frames = iter(range(1000))
    sizes = [[("a", 3), ("b", 9)], [("a", 3)], [("a", 0), ("b", 1)]]
    wanted: dict = {}
    try:
        for i, batch in enumerate(sizes):
            lines = []
            for place, (lane, n) in enumerate(batch):
                own = [next(frames) for _ in range(n)]
                wanted.setdefault(lane, []).extend(own)
                lines.append({"lane": lane, "place": place, "hiddens": [[float(x)] for x in own], "targets": [[x, 1] for x in own], "final": i == 2})
            (source / f"{i}.json").write_text("\n".join(map(json.dumps, lines)))
            query.processAllAvailable()
    finally:
        query.stop()
    rows = sorted(spark.read.parquet(out).collect(), key=lambda r: (r["lane"], r["batch_no"]))
    assert [(r["lane"], r["batch_no"], r["n_frames"]) for r in rows] == [("a", 0, 4), ("a", 1, 2), ("b", 0, 4), ("b", 1, 4), ("b", 2, 2)]
    for lane, want in wanted.items():
        assert [t[0] for r in rows if r["lane"] == lane for t in r["targets"]] == want
        assert [h[0] for r in rows if r["lane"] == lane for h in r["hiddens"]] == [float(x) for x in want]


def test_samples_without_parts_are_counted(spark, shards):
    import io
    import tarfile

    with tarfile.open(f"{shards}/z.tar", "w") as tar:
        for name in ("a.hiddens.npy", "b.meta.json"):
            info = tarfile.TarInfo(name)
            info.size = 1
            tar.addfile(info, io.BytesIO(b"x"))
    got = {r["shard"]: (r["n_keys"], r["n_incomplete"]) for r in tars.incomplete_samples(spark, shards).collect()}
    assert got["z.tar"] == (2, 2) and got["m_00000.tar"] == (4, 0) and len(got) == 7


# ------------------------------------------------------------------ models


def decoder(layers=2, width=16, backbone=12, heads=4, groups=2, books=5, vocabulary=7, spread=0.3):
    rng, d = np.random.default_rng(1), width // heads
    w = {"projection.weight": rng.normal(0, spread, (width, backbone)), "audio_embeddings.weight": rng.normal(0, spread, (vocabulary * books, backbone)), "audio_head": rng.normal(0, 0.02, (books - 1, width, vocabulary)), "decoder.norm.scale": np.ones(width)}
    for i in range(layers):
        at = f"decoder.layers.{i}"
        w |= {f"{at}.attn.q_proj.weight": rng.normal(0, spread, (width, width)), f"{at}.attn.output_proj.weight": rng.normal(0, spread, (width, width)), f"{at}.sa_norm.scale": np.ones(width), f"{at}.mlp_norm.scale": np.ones(width)}
        w |= {f"{at}.attn.{p}_proj.weight": rng.normal(0, spread, (groups * d, width)) for p in "kv"} | {f"{at}.mlp.w{k}.weight": rng.normal(0, spread, (24, width) if k != 2 else (width, 24)) for k in (1, 2, 3)}
    return M.DepthDecoder(w, heads, vocabulary)


def test_a_codebook_sees_only_those_before_it():
    model, rng = decoder(), np.random.default_rng(2)
    hiddens, codes = rng.normal(size=(3, 12)), rng.integers(0, 7, (3, 5))
    want = model.logits(hiddens, codes)
    assert want.shape == (3, 4, 7)
    for k in range(5):
        other = codes.copy()
        other[:, k] = (other[:, k] + 1) % 7
        same = np.isclose(model.logits(hiddens, other), want).all(axis=(0, 2))
        assert list(same) == [j < k for j in range(4)] if k < 4 else same.all()
    assert not np.allclose(model.logits(hiddens + 1, codes), want)


def test_an_untrained_decoder_is_at_the_chance_level(spark):
    model, rng = decoder(), np.random.default_rng(4)
    rows = [(f"k{i}", rng.normal(size=(n, 12)).tolist(), rng.integers(0, 7, (n, 5)).tolist()) for i, n in enumerate((40, 0, 80))]
    df = spark.createDataFrame(rows, "key string, hiddens array<array<double>>, targets array<array<int>>")
    scored = audio_frame_metrics(M.depth_scored(df, model, ["key"]), "logits", "targets")
    assert scored.count() == 120 * 4 and scored.agg(F.avg("nll")).first()[0] == pytest.approx(np.log(7), abs=0.1)


def test_codec_round_trip(spark):
    backend = M.ToyBackend()
    codes = np.random.default_rng(0).integers(0, 16, (9, 4))
    assert (backend.encode(backend.decode(codes)) == codes).all() and len(backend.decode(codes)) == 9 * 640
    df = spark.createDataFrame([(codes.tolist(),), (None,), ([],)], "c array<array<int>>")
    got = [r[0] for r in df.select(M.encoded(M.decoded(F.col("c"), backend), backend)).collect()]
    assert got == [codes.tolist(), None, []]


def test_generation_stops_and_keeps_to_its_budget(spark):
    backend = M.ToyBackend()
    assert len(M.generate(backend, "two words", "k", 5)) == 5
    found = M.generate(backend, "one two three", "k", 2000)
    assert 12 <= len(found) <= 24 and (found[:, 0] != backend.end).all()
    df = spark.createDataFrame([(1, "one two three"), (2, None), (3, "  ")], "id int, t string")
    got = {r["id"]: r["codes"] for r in M.generated(df, "id", "t", backend).collect()}
    assert got[2] == got[3] == [] and got[1] == M.generate(backend, "one two three", "1", 2000).tolist()


def test_scripts_turn_by_turn(spark):
    texts = {1: ["hello there you", "yes", "a b c d e f g h i j k l m n o p", "good night then"], 2: ["x", None, "what is it now"]}
    rows = [(s, i, i % 2, t) for s, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "script_id int, turn int, speaker int, text string").repartition(3)
    got = {(r["script_id"], r["turn"]): r for r in M.rendered(df, M.ToyBackend(), context_s=6.0).collect()}
    assert set(got) == {(s, i) for s, ts in texts.items() for i, t in enumerate(ts) if t}
    for s, ts in texts.items():
        start, past = 0.0, []
        for i, t in enumerate(ts):
            if not t:
                continue
            r = got[s, i]
            n, total = 0, 0.0
            for d in reversed(past):
                if n and total + d > 6.0:
                    break
                n, total = n + 1, total + d
            assert r["start_sec"] == pytest.approx(start) and r["context_turns"] == n and 1 <= r["attempt"] <= 3 and (not r["collapsed"] or r["attempt"] == 3)
            assert r["codes"] == M.generate(M.ToyBackend(), t, f"{s}/{i}/{r['attempt']}", 2000, round(total * 12.5)).tolist()
            start, past = start + r["duration_sec"] + 0.3, past + [r["duration_sec"]]
    assert M.rendered(df.limit(0), M.ToyBackend()).count() == 0


def test_temperature_zero_and_samplers(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 0.0],)], "lg array<double>")
    noise = F.array(*[F.lit(x) for x in (0.9, 0.5, 0.5, 0.999999)])
    got = df.select(L.temperature(F.col("lg"), 0.0), L.sample(F.col("lg"), noise, 0.0), L.sample(F.col("lg"), noise, 1.0, 1), L.sample(F.col("lg"), noise, 1.0), L.sample(F.col("lg"), noise, 1.0, 0, 0.01)).first()
    assert list(got[0]) == [-np.inf, 3.0, -np.inf, -np.inf] and got[1] == 1 and got[2] == 1 and got[3] == 3 and got[4] == 1


def test_trend_has_a_row_per_point_and_follows_curves(spark):
    rng = np.random.default_rng(0)
    x = np.sort(np.concatenate([rng.uniform(0, 1, 9000), rng.uniform(0, 100, 300)]))
    y = np.sin(x / 15) + rng.normal(0, 0.05, len(x))
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": x, "y": y})).unionByName(spark.createDataFrame([(None, 1.0, 2.0), (None, None, 1.0), ("a", 1.0, float("nan")), ("b", 3.0, 5.0)], "g string, x double, y double"))
    got = M.loess(df, ["g"], "x", "y", bandwidth=0.02).toPandas()
    own = got[got["g"] == "a"].sort_values("x")
    assert len(own) == len(x) and np.allclose(own["x"], x)
    near = int(np.ceil(0.02 * len(x)))
    for i in range(0, len(x), 150):  # the same regression on the points themselves
        d = np.abs(x - x[i])
        w = np.clip(1 - (d / np.sort(d)[near]) ** 3, 0, None) ** 3
        mx, my = np.average(x, weights=w), np.average(y, weights=w)
        slope = np.average((x - mx) * (y - my), weights=w) / np.average((x - mx) ** 2, weights=w)
        assert own["trend"].iloc[i] == pytest.approx(my + slope * (x[i] - mx), abs=0.03)
    assert got[got["g"].isna()]["trend"].tolist() == [2.0] and got[got["g"] == "b"]["trend"].tolist() == [5.0]
    assert M.loess(df.limit(0), ["g"], "x", "y").count() == 0


def test_chunks_of_samples(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([],), ([1.0, 2.0],), (None,)], "s array<double>")
    assert [r[0] for r in df.select(M.audio_chunks(F.col("s"), 2)).collect()][:3] == [[[1.0, 2.0], [3.0, 4.0], [5.0]], [], [[1.0, 2.0]]]
    assert M.chunk_size(30, 24_000, 12.5) == 720_000 and M.chunk_size(30.05, 24_000, 12.5) == 720_000 and M.chunk_size(0.001, 24_000, 12.5) == 1920


def test_tokens_as_a_table_function(spark):
    M.token_rows(spark, M.ToyBackend(), "t_rows")
    spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id int, text string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, t.pos, t.token FROM texts, LATERAL t_rows(text) AS t ORDER BY id, pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, 97), (1, 1, 98)]
