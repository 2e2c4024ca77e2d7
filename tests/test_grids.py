from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuro.functions import grids as G
from murmuro.functions import logits as L
from murmuro.operators.spans import check_grid
from murmuro.sources import audio, tables


def grid(spark, column, text, frames, k):
    rows = [(list(range(1, text + 1)), None if frames is None else [[7] * k for _ in range(frames)])]
    df = spark.createDataFrame(rows, "ids array<int>, codes array<array<int>>").select(column.alias("g"))
    return df.select("g", check_grid(F.col("g.tokens"), F.col("g.mask"), F.lit(k), F.lit(k)).alias("reason")).first()


@pytest.mark.parametrize(("prefix", "text", "frames", "k", "length"), [(None, 65, 297, 32, 363), (6, 70, 297, 16, 374)])
def test_golden_lengths(spark, prefix, text, frames, k, length):
    lead = None if prefix is None else F.array(*[F.lit(i) for i in range(prefix)])
    got = grid(spark, G.text_last(F.col("ids"), F.col("codes"), k, lead, 9), text, frames, k)
    tokens, mask = np.array(got["g"]["tokens"]), np.array(got["g"]["mask"])
    assert tokens.shape == mask.shape == (length, k + 1) and got["reason"] == "ok"
    assert mask[:text, -1].all() and not mask[:text, :-1].any() and not mask[text:, -1].any()
    assert tokens[-1].tolist() == [9] + [0] * k and mask[-1, :-1].all()
    if prefix:
        assert mask[text : text + prefix, 0].all() and not mask[text : text + prefix, 1:].any()


def test_no_codes_is_text_only(spark):
    got = grid(spark, G.text_last(F.col("ids"), F.col("codes"), 4), 3, None, 4)
    assert len(got["g"]["tokens"]) == 3 and got["reason"] == "ok"


def test_masks_prefixes_and_texts(spark):
    ids = {"think": 1, "nothink": 2, "think_bos": 3, "think_eos": 4, "pad": 5, "bos": 6}
    languages, voices = F.create_map(F.lit("english"), F.lit(50)), F.create_map(F.lit("ann"), F.lit(60))
    got = spark.range(1).select(
        G.codec_prefix(F.lit("English"), languages, F.lit("Bob"), voices, ids).alias("a"), G.codec_prefix(F.lit("Klingon"), languages, F.lit("ANN"), voices, ids).alias("b"),
        G.dual_mask(F.array(F.lit(1), F.lit(150)), 2, 100, 200).alias("m"), G.turn_text(F.lit(0), F.lit("  hi")).alias("t"), G.tagged_text(F.lit("x"), F.lit("hi")).alias("u"), G.tagged_text(F.lit("x"), F.lit("a <|speaker:y|>hi")).alias("v"),
    ).first()
    assert got["a"] == [1, 3, 50, 4, 5, 6] and got["b"] == [2, 3, 4, 60, 5, 6]
    assert got["m"] == [[True, False, False], [True, True, True]] and (got["t"], got["u"], got["v"]) == ("[0] hi", "<|speaker:x|>hi", "a <|speaker:y|>hi")


def test_layouts_targets_and_slices(spark):
    df = spark.createDataFrame([([[0.0, 1.0]], [[[1.0, 2.0, 3.0]], [[4.0]], []], [[1, 2, 3], [4, 5, 6], [7, 8, 9]])], "h array<array<double>>, l array<array<array<double>>>, t array<array<int>>")
    got = df.select(G.feature_layout(F.col("h"), F.col("l")).alias("f"), G.head_targets(F.col("t"), F.array(F.lit(0), F.lit(2))).alias("x"), G.audio_slice(F.col("t"), F.lit(1), F.lit(3), False).alias("s"), G.audio_slice(F.col("t"), F.lit(1), F.lit(3), True).alias("p")).first()
    assert (got["f"]["hidden_dim"], got["f"]["logit_dims"]) == (2, [3, 1, None])
    assert got["x"] == [[1, 3], [4, 6], [7, 9]] and got["s"] == [[4, 5, 6], [7, 8, 9]] and got["p"] == [[1, 2, 3], [4, 5, 6]]


def test_fused_filters_and_second_draws(spark):
    lg = F.array(*[F.lit(x) for x in (3.0, 2.0, 1.0, -5.0)])
    got = spark.range(1).select(L.fused_filters(lg, 0.5, 3, 0.95, 0.01, 3).alias("f")).first()["f"]
    assert got[0] == 6.0 and got[2] == -np.inf and got[3] == -10.0
    sure, flat = F.array(F.lit(50.0), F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.5))
    one = spark.range(1).select(L.repetition_aware(sure, F.array(F.lit(0)), flat, flat, 0.9, 5, 0, 9).alias("a"), L.repetition_aware(F.array(F.lit(0.0), F.lit(0.01)), F.array(F.lit(1)), F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.99), F.lit(0.01)), 1.5, 5, 0, 9, 1.5).alias("b")).first()
    assert one["a"] == 0 and one["b"] == 0


def test_loading(spark, tmp_path):
    a = spark.createDataFrame([("m", 1, 0, "x"), ("m", 1, 1, "y")], "model string, row_id int, seq_id int, v string")
    c = spark.createDataFrame([("m", 1, 1, b"kv"), ("m", 2, 0, b"kv")], "model string, row_id int, seq_id int, cache binary")
    a.write.parquet(f"{tmp_path}/a")
    c.write.parquet(f"{tmp_path}/c")
    assert sorted((r["v"], r["cache"] is None) for r in tables.load_sequences(spark, f"{tmp_path}/a", f"{tmp_path}/c").collect()) == [("x", True), ("y", False)]
    assert sorted((r["seq_id"], r["side"]) for r in tables.unmatched(a, c).collect()) == [(0, "featurized"), (0, "tokenized")]
    good, bad = tables.split_valid(a, F.when(F.col("v") == "x", "ok").otherwise("wrong"))
    assert good.count() == 1 and bad.first()["reason"] == "wrong"
    assert tables.resampled(spark.range(1000), 2.0, 1).count() > 1500


def test_warmup(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "one.wav").write_bytes(audio.encode(np.zeros((1, 50)), 8000))
    (tmp_path / "m.yaml").write_text("segments:\n  - {speaker: 1, audio: clips/one.wav, text: hello}\n")
    row = tables.read_warmup(spark, str(tmp_path / "m.yaml"), audio.read_wav(spark, str(tmp_path))).first()
    assert (row["speaker"], row["text"], len(row["samples"])) == (1, "hello", 50)
    (tmp_path / "n.yaml").write_text("segments:\n  - {speaker: 1, audio: two.wav, text: hello}\n")
    with pytest.raises(FileNotFoundError):
        tables.read_warmup(spark, str(tmp_path / "n.yaml"), audio.read_wav(spark, str(tmp_path)))
