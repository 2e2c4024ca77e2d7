from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuro.functions import logits as L
from murmuro.operators.metrics import audio_frame_metrics

RNG = np.random.default_rng(3)


def one(spark, values, *exprs):
    df = spark.createDataFrame([([float(v) for v in values],)], "lg array<double>")
    return df.select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first()


def log_softmax(x):
    x = np.asarray(x, float)
    return x - (x.max() + np.log(np.exp(x - x.max()).sum()))


@pytest.mark.parametrize("values", [RNG.normal(0, 3, 40), [1e4, -1e4, 0.0], [0.0] * 7, [5.0], RNG.normal(0, 1, 300)], ids=["random", "extreme", "uniform", "single", "many"])
def test_scores_against_numpy(spark, values):
    p = log_softmax(values)
    got = one(spark, values, L.nll(F.col("lg"), F.lit(0)), L.entropy(F.col("lg")), L.log_sum_exp(F.col("lg")), F.get(L.softmax(F.col("lg")), F.lit(0)), F.get(L.log_softmax(F.col("lg")), F.lit(0)))
    assert got == pytest.approx([-p[0], -(np.exp(p) * p).sum(), np.asarray(values)[0] - p[0], np.exp(p[0]), p[0]], abs=1e-9)


def test_uniform_logits_give_the_chance_level_and_a_shift_changes_nothing(spark):
    got = one(spark, [2.0] * 16, L.nll(F.col("lg"), F.lit(3)), L.entropy(F.col("lg")), L.nll(F.transform("lg", lambda x: x + 100), F.lit(3)))
    assert got == pytest.approx([np.log(16)] * 3)


def test_minus_infinity_makes_entropy_nan_unless_asked_otherwise(spark):
    got = one(spark, [0.0, float("-inf"), 0.0], L.entropy(F.col("lg")), L.entropy(F.col("lg"), nan_safe=True), L.nll(F.col("lg"), F.lit(0)))
    assert np.isnan(got[0]) and got[1:] == pytest.approx([np.log(2), np.log(2)])


def test_targets_outside_and_null(spark):
    got = one(spark, [0.0, 1.0], L.nll(F.col("lg"), F.lit(7)), L.nll(F.col("lg"), F.lit(None).cast("int")))
    assert got[0] is None and got[1] is None


def test_ties_go_to_the_first_id(spark):
    got = one(spark, [1.0, 3.0, 3.0, 2.0, 3.0], L.argmax(F.col("lg")), L.top_k(F.col("lg"), 2), L.top_k(F.col("lg"), 99))
    assert got[0] == 1 and [i for i, x in enumerate(got[1]) if x > -np.inf] == [1, 2] and list(got[2]) == [1.0, 3.0, 3.0, 2.0, 3.0]


@pytest.mark.parametrize("p", [0.05, 0.4, 0.9, 1.0])
def test_nucleus_against_numpy(spark, p):
    values = RNG.normal(0, 2, 30)
    order = np.lexsort((np.arange(30), -values))
    mass = np.cumsum(np.exp(log_softmax(values))[order])
    keep = [int(i) for r, i in enumerate(order) if r == 0 or mass[r] <= p]
    got = one(spark, values, L.nucleus(F.col("lg"), p), L.top_p(F.col("lg"), p), L.nucleus(F.col("lg"), p, 3))
    if p < 1:
        assert got[0] == keep
        assert sorted(i for i, x in enumerate(got[1]) if x > -np.inf) == sorted(keep)
        assert got[2] == keep[:3]
    else:
        assert len(got[0]) >= 29


def test_penalty_counts_each_id_once(spark):
    got = one(spark, [2.0, -2.0, 1.0], L.repetition_penalty(F.col("lg"), F.array(F.lit(0), F.lit(0), F.lit(1)), 2.0), L.suppress(F.col("lg"), F.array(F.lit(0))), L.min_p(F.col("lg"), 0.5), L.temperature(F.col("lg"), 0.5))
    assert list(got[0]) == [1.0, -4.0, 1.0]
    assert list(got[1]) == [-np.inf, -2.0, 1.0] and list(got[2]) == [2.0, -np.inf, -np.inf] and list(got[3]) == [4.0, -4.0, 2.0]


def test_a_race_draws_by_probability(spark):
    noise = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.pmod(F.xxhash64(F.col("id"), i), F.lit(1_000_003)) + 1) / 1_000_004)
    lg = F.array(*[F.lit(float(np.log(x))) for x in (0.6, 0.3, 0.1)])
    got = {r["t"]: r["count"] for r in spark.range(20_000).select(L.race(lg, noise).alias("t")).groupBy("t").count().collect()}
    assert [got[i] / 20_000 for i in range(3)] == pytest.approx([0.6, 0.3, 0.1], abs=0.02)


@pytest.mark.parametrize("engine", ["jvm", "arrow"])
@pytest.mark.parametrize("nan_safe", [False, True])
def test_both_engines(spark, engine, nan_safe):
    rows = [(i, [RNG.normal(0, 2, 9).tolist(), [0.0, float("-inf"), 1.0]], [3, 2]) for i in range(20)] + [(50, [[1.0, 2.0]], [None]), (51, [[1.0]], [9]), (52, None, [1]), (53, [], [])]
    df = spark.createDataFrame(rows, "id int, logits array<array<double>>, targets array<int>")
    got = {(r["id"], r["codebook"]): (r["entropy"], r["nll"]) for r in audio_frame_metrics(df, "logits", "targets", nan_safe, engine).collect()}
    assert len(got) == 42
    for i, heads, targets in rows[:20]:
        for k, (x, t) in enumerate(zip(heads, targets)):
            p = log_softmax(x)
            e = np.nansum(-np.exp(p) * p) if nan_safe else -(np.exp(p) * p).sum()
            assert got[i, k] == pytest.approx((e, -p[t]), abs=1e-9, nan_ok=True)
    assert all(got[k][1] is None or np.isnan(got[k][1]) for k in ((50, 0), (51, 0)))
