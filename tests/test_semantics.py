"""Published figures, and the places where a plain reading gives another result."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from murmuro.functions import scalars as S
from murmuro.operators import dialogue as D
from murmuro.operators import metrics as M
from murmuro.operators import segments as G
from murmuro.operators import shards as H
from murmuro.operators import spans as P
from murmuro.operators import timing as T
from murmuro.plans import speech


def value(spark, *exprs):
    return tuple(spark.range(1).select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first())


@pytest.mark.parametrize(("semantic", "audio", "rate", "k", "want"), [(1.79, 4.29, 12.5, 32, (0.032, 2.397)), (8.31, 5.81, 12.5, 16, (0.150, 1.571)), (4.56, 4.79, 21.0, 10, (0.138, 1.306))])
def test_published_bitrates(spark, semantic, audio, rate, k, want):
    got = value(spark, S.kbits_per_second(F.lit(semantic), F.lit(rate), F.lit(1)), S.kbits_per_second(F.lit(audio), F.lit(rate), F.lit(k - 1)))
    assert got == pytest.approx(want, abs=3e-3)


@pytest.mark.parametrize(("rate", "frames"), [(12.5, 297), (21.0, 499)])
def test_frames_of_the_golden_segment(spark, rate, frames):
    df = spark.createDataFrame([(0.0, 23.76), (None, 1.0), (1.0, 1.0), (500.0, 501.0)], "start_sec double, end_sec double")
    got = [(r["frame_start"], r["frame_end"]) for r in G.frame_bounds(df, F.lit(rate), F.lit(5000)).collect()]
    assert (0, frames) in got and len(got) == (2 if rate == 12.5 else 1)
    assert value(spark, S.frame_start(F.lit(-1.0), F.lit(rate)), S.frame_end(F.lit(1e6), F.lit(rate), F.lit(100))) == (0, 100)


def test_every_frame_meets_its_segments(spark, tmp_path):
    rows = [(1, 0, 0, 0.0, 1.0), (1, 0, 1, 0.5, 3.1), (1, 0, 2, 2.5, 2.7), (1, 1, 3, 0.3, 0.4), (2, 0, 4, 30.0, 30.2), (2, 0, 5, 5.0, 4.0)]
    spark.createDataFrame(rows, "source_dataset_id long, source_audio_channel_id int, segment_id int, start_sec double, end_sec double").write.parquet(f"{tmp_path}/segments.parquet")
    want = {}
    for row, channel, _, start, end in rows:
        for f in range(math.floor(start * 12.5), math.ceil(end * 12.5)):
            want[row, channel, f] = want.get((row, channel, f), 0) + 1
    assert {tuple(r)[:3]: r["n_segments"] for r in speech.segment_frames_all(spark, str(tmp_path)).collect()} == want


def metrics(spark, rows):
    return spark.createDataFrame(rows, "model string, row_id long, seq_id int, frame_idx int, codebook int, entropy float, nll float")


def test_groups_add_up_and_frames_are_pooled(spark):
    rows = [("m", 1, s, f, k, 1.0, float(k + s)) for s, n in ((0, 1), (1, 9)) for f in range(n) for k in range(4)] + [("m", 1, 1, 50, 0, float("nan"), float("inf")), ("m", 1, 1, 51, 1, None, None)]
    out = {r["scope"]: r for r in M.nll_summary(metrics(spark, rows), ["model"], F.lit(12.5)).collect()}
    assert out["semantic"]["kbps"] + out["audio"]["kbps"] == pytest.approx(out["total"]["kbps"])
    assert out["semantic"]["avg_nll"] == pytest.approx(0.9) and out["total"]["avg_nll"] == pytest.approx(2.4)
    shares = M.nll_breakdown(metrics(spark, rows), ["model"], F.lit(12.5)).collect()
    assert sum(r["share_pct"] for r in shares if r["codebook"] != "-") == pytest.approx(100)


def test_one_codebook_has_no_halves(spark):
    out = M.group_entropy(metrics(spark, [("m", 1, 0, 0, 0, 1.0, 1.0)]), ["model"], F.lit(1)).first()
    assert out["semantic"] == pytest.approx(1 / math.log(2)) and out["audio_half_1"] is None and out["audio_half_2"] is None


def test_latest_runs(spark):
    df = spark.createDataFrame([("m", 1, 0, 1, "a"), ("m", 1, 0, 2, "b"), ("m", 1, None, None, "c"), ("m", None, 0, 5, "d")], "model string, row_id long, seq_id int, computed_at int, x string")
    assert sorted(r["x"] for r in M.latest_runs(df).collect()) == ["b", "c", "d"]


def test_sums_of_the_last_run_are_those_of_its_rows(spark):
    rows = [("m", r, s, f, k, float(f + k), float(run * 100 + f), run) for r in (1, None) for s in (0, None) for run in ((1, 2) if s == 0 else (3,)) for f in range(3) for k in range(2)]
    rows.append(("m", 1, 0, 9, 0, float("nan"), 5.0, 2))
    df = spark.createDataFrame(rows, "model string, row_id long, seq_id int, frame_idx int, codebook int, entropy float, nll float, computed_at int")
    direct = M.nll_summary(M.latest_runs(df), ["model"], F.lit(12.5)).collect()
    assert sorted(M.nll_summary(M.latest_cells(df), ["model"], F.lit(12.5)).collect()) == sorted(direct)
    frames = ["model", "row_id", "seq_id", "frame_idx"]
    assert sorted(M.group_entropy(df, frames, F.lit(2), latest=True).collect(), key=repr) == sorted(M.group_entropy(M.latest_runs(df), frames, F.lit(2)).collect(), key=repr)


def test_layouts(spark):
    assert value(spark, S.text_column(F.lit(-1), F.lit(32)), S.text_column(F.lit(0), F.lit(10)), F.size(S.audio_channels(F.lit(-1), F.lit(16)))) == (32, 0, 16)


def test_formats(spark):
    got = value(spark, S.duration(F.lit(3725.5)), S.slug(F.lit("Org/Name Of_It V1.0!")), S.preview(F.lit("x" * 60)), S.preview(F.lit("x" * 61)), S.sample_key(F.lit(7), F.lit(3)), S.ratio(F.lit(1.0), F.lit(0.0)))
    assert got == ("01:02:05.500", "name-of_it-v1.0-", "x" * 60, "x" * 57 + "...", "00000007_00003", 0.0)


@pytest.mark.parametrize(("text", "seconds", "want"), [("a b c", 1.0, False), ("a b c", 0.1, True), ("a b c", 9.0, True), ("", 1.0, False), (None, 1.0, False), ("a b c", 2.0, False), ("a", 0.0, True)])
def test_collapsed_turns(spark, text, seconds, want):
    assert value(spark, S.is_collapsed(F.lit(text).cast("string"), F.lit(seconds)))[0] is want


def test_budget_and_sounds(spark):
    assert value(spark, S.token_budget(F.lit(1), 2000), S.token_budget(F.lit(10), 2000), S.token_budget(F.lit(999), 2000)) == (32, 120, 2000)
    xs = F.array(*[F.lit(float(i)) for i in range(5)])
    got = value(spark, S.stretch(xs, F.lit(2.0)), S.stretch(xs, F.lit(9.0)), S.stretch(xs, F.lit(0.5)), S.mixdown(F.array(xs, F.transform(xs, lambda x: x + 2))))
    assert got[0] == [0.0, 4.0] and got[1] == [0.0] and len(got[2]) == 10 and got[3] == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_grid_checks(spark):
    rows = [([[1, 2, 0]], [[True, True, False]]), ([[1, 2, 3]], [[True, True, False]]), ([[1, 0, 3]], [[False, False, True]]), ([[1, 2]], [[True, True]]), ([[1, 2, 0]], [[True, False, False]]), ([], [])]
    df = spark.createDataFrame(rows, "t array<array<int>>, m array<array<boolean>>")
    assert [r[0] for r in df.select(P.check_grid(F.col("t"), F.col("m"), F.lit(2), F.lit(2))).collect()] == ["ok", "text", "audio", "shape", "ok", "ok"]


def test_templates(spark):
    rows = spark.createDataFrame([(0, 65, 297), (1, 10, None), (2, 5, 3)], "segment_id int, n int, frames int").withColumn("row", F.lit(1))
    got = P.template(rows, F.col("n"), F.col("frames"), 0, 1, ["segment_id"], ["row"]).orderBy("span_start").collect()
    assert [(r["kind"], r["span_start"], r["span_end"]) for r in got] == [("text", 0, 65), ("audio", 65, 362), ("special", 362, 363), ("text", 363, 373), ("text", 373, 378), ("audio", 378, 381), ("special", 381, 382)]
    got = P.template(rows.limit(1), F.lit(70), F.col("frames"), 6, 1, ["segment_id"], ["row"]).orderBy("span_start").collect()
    assert [(r["kind"], r["span_start"], r["span_end"]) for r in got] == [("text", 0, 70), ("special", 70, 76), ("audio", 76, 373), ("special", 373, 374)]


def test_spans(spark):
    rows = [("m", 1, 0, 0, "Text ", 1, 5, 0, 5), ("m", 1, 0, 0, "Text ", 1, 5, 0, 5), ("m", 1, 0, 1, "audio", 1, 5, 5, 9), ("m", 1, 0, 2, "AUDIO", 1, 5, 9, 11), ("m", 1, 1, 0, "audio", 1, 6, 0, 4), ("m", 1, 1, 1, "odd", 1, None, 4, 4)]
    s = P.spans_once(spark.createDataFrame(rows, "model string, row_id long, seq_id int, span_no int, span_kind string, source_dataset_id long, segment_id int, span_start int, span_end int"))
    assert s.count() == 5
    assert sorted((r["feature_start"], r["feature_end"]) for r in P.feature_slices(s).collect()) == [(4, 8), (8, 10)]
    assert sorted(r["reason"] for r in P.check_spans(s).collect()) == ["first", "kind", "ok", "ok", "ok"]
    p = {r["segment_id"]: r for r in P.pivot_kinds(s).collect()}
    assert (p[5]["text_start"], p[5]["audio_start"], p[5]["audio_end"], p[6]["text_start"]) == (0, 9, 11, None)


@pytest.mark.parametrize("n", [0, 1, 19, 20, 500])
def test_split_is_disjoint_and_whole(spark, n):
    out = H.shuffle_split(spark.range(n), F.col("id"), per_shard=7).collect()
    assert sorted(r["id"] for r in out) == list(range(n))
    assert sum(r["split"] == "train" for r in out) == int(n * 0.95)
    for split in ("train", "val"):
        shards = [r["shard"] for r in out if r["split"] == split]
        assert all(shards.count(s) == 7 for s in set(shards) if s != max(shards))


def test_batches_hold_all_frames(spark):
    df = spark.createDataFrame([("m", i, n) for i, n in enumerate([5, 0, 30, 1, 64, 3])], "model string, i int, n int")
    got = {r["batch_no"]: r["n_frames"] for r in H.frame_batches(df, ["model"], F.floor(F.col("i") / 2), ["i"], "n", 16).collect()}
    assert got == {0: 16, 1: 16, 2: 16, 3: 16, 4: 16, 5: 16, 6: 7}
    assert H.frame_batches(df, ["model"], F.floor(F.col("i") / 2), ["i"], "n", 16, True).count() == 6


def test_attempts_stops_and_stitches(spark):
    rows = [("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, False), ("b", 2, None), ("c", 1, False), ("c", 2, False), ("c", 3, False), ("c", 4, True)]
    df = spark.createDataFrame(rows, "k string, t int, ok boolean")
    got = {r["k"]: (r["t"], r["attempt_no"], r["is_good"]) for r in D.pick_attempt(df, ["k"], ["t"], F.col("ok"), ["t"]).collect()}
    assert got == {"a": (2, 2, True), "b": (2, 2, False), "c": (3, 3, False)}
    assert sorted((r["k"], r["t"]) for r in D.take_while(df, ["k"], "t", F.col("ok")).collect()) == [("a", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("c", 3)]
    out = D.stitch(df, ["k"], F.floor(F.col("t") / 2), ["t"], "t", 10).where("k = 'c'").orderBy("t").collect()
    assert [r["offset_ms"] for r in out] == [0, 11, 23, 36]
    chunks = D.chunks(spark.range(60).withColumn("k", F.lit(1)), ["k"], "id", 2.0, 12.5).orderBy("chunk_no").collect()
    assert [(r["n_frames"], r["is_final"]) for r in chunks] == [(25, False), (25, False), (10, True)]


def test_timings(spark):
    df = spark.createDataFrame([("a", 80.0), ("a", 40.0), ("b", None)], "k string, ms double")
    v = F.col("ms")
    got = {r["k"]: r for r in T.step_stats(df, ["k"], v, v / 2, v / 2, v / 4).collect()}
    assert (got["a"]["n"], got["a"]["gen_mean"], got["a"]["decode_mean"]) == (2, 60.0, 15.0) and got["a"]["rate"] == pytest.approx(2 / 0.12)
    assert got["b"]["n"] == 0 and got["b"]["rate"] == 0.0 and got["b"]["gen_mean"] == 0.0
    g = T.generations(df, ["k"], v, 12.5)
    a = {r["k"]: r for r in g.collect()}
    assert a["a"]["rtf"] * a["a"]["speed_x"] == pytest.approx(1) and a["b"]["rtf"] == 0.0
    assert T.bench_aggregate(g).first()["mean_rtf"] == pytest.approx(a["a"]["rtf"] / 2)


def test_quality_gate_and_residual_levels(spark):
    rows = [("m", 1, 0, f, k, 0.5, 1.0 + k) for f in range(3) for k in range(3)]
    gate = {r["codebook"]: r for r in M.quality_gate(metrics(spark, rows), F.lit(16.0)).collect()}
    assert gate[0]["passes"] and not gate[2]["passes"] and gate[1]["excess"] == pytest.approx(1.5)
    out = M.residual_eval(metrics(spark, rows), F.lit(12.5)).first()
    assert (out["n_frames"], out["avg_nll"], out["worst_codebook"], out["worst_nll"]) == (3, 2.5, 2, 3.0)


def test_segments_against_recordings(spark):
    raw = spark.createDataFrame([(1, "d", "train", 8000, 2, 10.0, 1), (1, "d", "train", 8000, 9, 99.0, 0), (2, None, None, None, None, float("nan"), 0)], "row_id long, dataset string, split_name string, sample_rate int, num_channels int, duration_sec double, added_at int")
    seg = spark.createDataFrame([(1, 0, 0.0, 10.0001), (1, 2, 0.0, 1.0), (1, 0, -1.0, 1.0), (1, 0, 2.0, 2.0), (1, 0, 0.0, 10.1), (2, 9, 0.0, 1e9), (3, 0, 0.0, 1.0), (1, 0, None, 1.0)], "source_dataset_id long, source_audio_channel_id int, start_sec double, end_sec double")
    assert sorted(r["reason"] for r in G.check_segments(seg, raw).collect()) == sorted(["ok", "channel", "negative", "reversed", "late", "ok", "no recording", "no time"])
