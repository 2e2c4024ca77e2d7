from __future__ import annotations

import datetime

import numpy as np
import pytest

from murmuro.llm import quantiles as Q

RNG = np.random.default_rng(5)
KINDS = {
    "heavy tails": lambda n: RNG.standard_cauchy(n), "positive": lambda n: RNG.lognormal(0, 1, n), "narrow": lambda n: RNG.uniform(4, 4.001, n), "both signs": lambda n: RNG.normal(0, 1e-3, n),
    "ties": lambda n: np.where(RNG.random(n) < 0.7, RNG.integers(0, 12, n) * 0.5, RNG.normal(2, 2, n)), "one value": lambda n: np.full(n, 1.5),
}


def sketch(values, sign=1):
    out = Q.Sketch()
    for part in np.array_split(values.astype(np.float32), max(1, len(values) // 20_000)):
        codes, counts = np.unique(Q.encode(part), return_counts=True)
        out.add(codes, sign * counts)
    return out


def rank_error(values, answers, percents):
    v = np.sort(values.astype(np.float32))
    low, high = np.searchsorted(v, np.float32(answers), "left"), np.searchsorted(v, np.float32(answers), "right")
    wanted = np.ceil(np.array(percents) * len(v) / 100)
    return np.maximum(0, np.maximum(low + 1 - wanted, wanted - high)).max() / len(v)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("n", [1, 900, 60_000, 400_000])
def test_rank_error_is_within_the_bound(kind, n):
    values, percents = KINDS[kind](n), list(range(1, 100))
    error = rank_error(values, sketch(values).percentiles(percents), percents)
    assert error <= (Q.RANK_ERROR if n > Q.KEPT else 0)


def test_codes_keep_order_and_come_back():
    values = np.sort(np.concatenate([RNG.normal(0, 1, 500), [0.0, -0.0, 1e-40, -1e-40, 3e38, -3e38]]).astype(np.float32))
    codes = Q.encode(values)
    assert (np.diff(codes.astype(np.int64)) >= 0).all()
    assert [Q.decode(int(c)) for c in codes] == [float(v) + 0.0 for v in values]


def test_merging_is_addition_in_any_order():
    parts = [RNG.normal(i, 1, 30_000) for i in range(4)]
    whole, turned = Q.Sketch(), Q.Sketch()
    for p in parts:
        whole.merge(Q.Sketch.from_bytes(sketch(p).to_bytes()))
    for p in reversed(parts):
        turned.merge(sketch(p))
    percents = [1, 10, 50, 90, 99]
    for s in (whole, turned):
        assert s.total == 120_000
        assert rank_error(np.concatenate(parts), s.percentiles(percents), percents) <= Q.RANK_ERROR


def test_deleting_rows_leaves_the_others():
    kept, gone = RNG.normal(0, 1, 80_000), RNG.normal(9, 1, 80_000)
    both = sketch(np.concatenate([kept, gone]))
    both.merge(sketch(gone, -1))
    percents = [5, 50, 95]
    assert both.total == 80_000
    assert rank_error(kept, both.percentiles(percents), percents) <= 3 * Q.RANK_ERROR


def test_nothing_left():
    one = sketch(np.array([1.0, 2.0]))
    one.merge(sketch(np.array([1.0, 2.0]), -1))
    assert one.total == 0 and one.percentiles([50]) == [None]


SCHEMA = "model string, codebook int, entropy float, nll float, computed_at timestamp, sketch string, metric string, n string, p50 string"


def rows(n=3000):
    out = []
    for i in range(n):
        value = [1.5, float("nan"), float("inf"), None][i % 4] if i % 5 == 0 else float(i % 97)
        out.append((None if i % 11 == 0 else f"m{i % 2}", None if i % 13 == 0 else i % 3, value, float(i), datetime.datetime(2025, 1, 1 + i % 3), "x", "y", "z", "w"))
    return out


def test_groups_days_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA).repartition(5).withColumn("day", F.to_date("computed_at"))
    keys = ["model", "codebook"]
    got = {(r["model"], r["codebook"], r["metric"]): r for r in Q.percentiles(Q.sketches(df, keys, ["entropy", "nll"]), keys).collect()}
    days = Q.merged(Q.sketches(df, [*keys, "day"], ["entropy", "nll"]), [*keys, "day"])
    again = {(r["model"], r["codebook"], r["metric"]): r for r in Q.percentiles(days, keys).collect()}
    assert got == again and len(got) == 24
    for key in {(r[0], r[1]) for r in rows()}:
        values = np.sort([r[2] for r in rows() if (r[0], r[1]) == key and r[2] is not None and np.isfinite(r[2])])
        found = got[(*key, "entropy")]
        assert found["n"] == len(values)
        assert found["p50"] == values[int(np.ceil(len(values) / 2)) - 1] and found["p99"] == values[int(np.ceil(len(values) * 0.99)) - 1]


def test_empty_table_and_groups_without_values(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Q.percentiles(Q.sketches(empty, ["model"], ["nll"]), ["model"]).count() == 0
    nothing = spark.createDataFrame([("a", 0, None, float("nan"), None, "", "", "", "")], SCHEMA)
    assert Q.percentiles(Q.sketches(nothing, ["model"], ["entropy", "nll"]), ["model"]).count() == 0


def test_tasks_pass_on_what_they_hold(spark, monkeypatch):
    df = spark.range(50_000).selectExpr("cast(id % 3 as int) as g", "cast(id as float) as v")
    got = Q.percentiles(Q.sketches(df, ["g"], ["v"]), ["g"], [50]).collect()
    assert sorted((r["g"], r["n"]) for r in got) == [(0, 16667), (1, 16667), (2, 16666)]
    assert all(abs(r["p50"] - 25_000) < 50_000 * Q.RANK_ERROR * 2 for r in got)


@pytest.mark.parametrize("kind", KINDS)
def test_doubles_beyond_the_range_of_floats(kind):
    values = KINDS[kind](200_000) * 1e300 if kind != "narrow" else 1e15 + RNG.integers(0, 100_000, 200_000).astype(float)
    values = values[np.isfinite(values)]
    s = Q.Sketch(64)
    for part in np.array_split(values, 8):
        codes, counts = np.unique(Q.encode(part, 64), return_counts=True)
        s.add(codes, counts)
    s = Q.Sketch.from_bytes(s.to_bytes())
    percents = list(range(1, 100))
    v, answers = np.sort(values), np.array(s.percentiles(percents))
    wanted = np.ceil(np.array(percents) * len(v) / 100)
    low, high = np.searchsorted(v, answers, "left"), np.searchsorted(v, answers, "right")
    assert s.total == len(v) and np.maximum(0, np.maximum(low + 1 - wanted, wanted - high)).max() / len(v) <= Q.RANK_ERROR


def test_columns_of_other_types_keep_their_values(spark):
    df = spark.createDataFrame([(1e300, 16777217, 1.5), (-1e300, 16777217, 2.5), (1e-300, 3, None), (float("inf"), 5, float("nan"))], "d double, i long, f float")
    got = {r["metric"]: r for r in Q.percentiles(Q.sketches(df, [], ["d", "i", "f"]), [], [1, 50, 99]).collect()}
    assert (got["d"]["n"], got["d"]["p01"], got["d"]["p50"], got["d"]["p99"]) == (3, -1e300, 1e-300, 1e300)
    assert (got["i"]["n"], got["i"]["p50"], got["i"]["p99"]) == (4, 5.0, 16777217.0) and got["f"]["n"] == 2


@pytest.mark.parametrize("bits", [32, 64])
def test_sketches_survive_bytes(bits):
    for n in (0, 1, 700, 50_000):
        s = Q.Sketch(bits)
        codes, counts = np.unique(Q.encode(RNG.normal(0, 100, n), bits), return_counts=True)
        s.add(codes, counts)
        back = Q.Sketch.from_bytes(s.to_bytes())
        assert (back.codes == s.codes).all() and (back.counts == s.counts).all() and back.total == s.total == n
        assert back.percentiles([1, 50, 99]) == s.percentiles([1, 50, 99])


def test_counters_answer_where_groups_are_large(spark):
    """Ranks of answers from counters, against the sorted values; the groups of this table have more values than are kept."""
    df = spark.read.parquet("/root/testdata/sf0.01/model_metrics.parquet")
    assert df.groupBy("model", "codebook").agg({"nll": "count"}).agg({"count(nll)": "min"}).first()[0] > 2 * Q.KEPT
    got = {(r["model"], r["codebook"]): r for r in Q.percentiles(Q.sketches(df, ["model", "codebook"], ["nll"]), ["model", "codebook"]).collect()}
    values = df.select("model", "codebook", "nll").toPandas()
    inexact = 0
    for key, own in values[np.isfinite(values["nll"])].groupby(["model", "codebook"], dropna=False)["nll"]:
        answers = [got[key][f"p{p:02g}"] for p in Q.PERCENTILES]
        error = rank_error(own.to_numpy(), answers, Q.PERCENTILES)
        assert error <= Q.RANK_ERROR + 1 / len(own)
        inexact += error > 0
    assert inexact > 0
