from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from murmuro.operators.intervals import periods_and_gaps, to_ms, valid_segments


def brute(rows):
    """(key, kind, from, to) by a sweep over each key's sorted intervals."""
    out = []
    for key in {k for k, _, _ in rows}:
        open_ = None
        for s, e in sorted((s, e) for k, s, e in rows if k == key and s is not None and e is not None and e > s):
            if open_ and s <= open_[1]:
                open_[1] = max(open_[1], e)
                continue
            if open_:
                out += [(key, "period", *open_), (key, "gap", open_[1], s)]
            open_ = [s, e]
        if open_:
            out.append((key, "period", *open_))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_against_a_sweep(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        key = rng.choice(["hot"] * 6 + ["a", "b", None, ""])
        s = rng.randrange(4000) if seed < 3 else rng.randrange(200_000)
        rows.append((key, s, s + rng.choice([-3, 0, 1, 2, 7, 40, 300 if seed % 2 else 3])))
    rows += rows[:50] + [("a", None, 5), ("a", 5, None)]
    df = spark.createDataFrame(rows, "k string, s long, e long").repartition(5)
    got = [(r["k"], r["kind"], r["from_ms"], r["to_ms"]) for r in periods_and_gaps(df, ["k"], "s", "e").collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_one_interval_over_all_partitions(spark):
    rows = [("x", 0, 10_000)] + [("x", i * 10, i * 10 + 5) for i in range(900)] + [("x", 20_000, 20_001)]
    got = periods_and_gaps(spark.createDataFrame(rows, "k string, s long, e long"), ["k"], "s", "e").collect()
    assert sorted((r["kind"], r["from_ms"], r["to_ms"]) for r in got) == [("gap", 10_000, 20_000), ("period", 0, 10_000), ("period", 20_000, 20_001)]


def test_touching_intervals_leave_no_gap_and_several_keys_may_be_null(spark):
    rows = [(1, None, 0, 5), (1, None, 5, 9), (None, None, 0, 1), (1, 2, 7, 8)]
    got = periods_and_gaps(spark.createDataFrame(rows, "a int, b int, s long, e long"), ["a", "b"], "s", "e").collect()
    assert sorted([(r["a"], r["b"], r["kind"], r["from_ms"], r["to_ms"]) for r in got], key=repr) == sorted([(1, None, "period", 0, 9), (None, None, "period", 0, 1), (1, 2, "period", 7, 8)], key=repr)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "k string, s long, e long")
    assert periods_and_gaps(empty, ["k"], "s", "e").count() == 0
    clashing = spark.createDataFrame([("a", 1, 3, "x", "y", "z", "w")], "k string, s long, e long, __key string, __start string, kind string, from_ms string")
    assert periods_and_gaps(clashing, ["k"], "s", "e").count() == 1


def test_milliseconds(spark):
    rows = [(0.0004, 0.001), (0.1 + 0.2, 0.3004), (None, 1.0), (float("nan"), 1.0), (2.0, 1.0), (float("inf"), 2.0), (1.0, 1.0004)]
    df = spark.createDataFrame(rows, "start_sec double, end_sec double")
    assert [(r["start_ms"], r["end_ms"]) for r in valid_segments(df).collect()] == [(0, 1)]
    assert spark.range(1).select(to_ms(F.lit(1e300))).first()[0] is None


def test_large_numbers_beside_nulls_stay_exact(spark):
    big = (1 << 60) + 1
    got = periods_and_gaps(spark.createDataFrame([(big, 0, 1), (None, 0, 1), (big, 5, 6)], "k long, s long, e long"), ["k"], "s", "e").collect()
    assert {r["k"] for r in got} == {big, None}
