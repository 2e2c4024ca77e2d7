from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuro.operators import ordered as O


def walk(lengths, limit):
    fill, chunk, out = 0, -1, []
    for n in lengths:
        if fill and fill + n <= limit:
            fill += n
        else:
            chunk, fill = chunk + 1, n
        out.append(chunk)
    return out


@pytest.mark.parametrize("limit", [1, 10, 60, 100_000])
@pytest.mark.parametrize("seed", range(3))
def test_greedy_pack_against_a_loop(spark, seed, limit):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), i, rng.choice([1, 2, 3, 9, 30, 200 if seed == 2 else 4])) for i in range(1500)] + [("a", 9999, None)]
    got = {(r["k"], r["i"]): (r["chunk_no"], r["oversized"]) for r in O.greedy_pack(spark.createDataFrame(rows, "k string, i int, n int").repartition(5), ["k"], ["i"], "n", limit).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key and r[2] is not None), key=lambda r: r[1])
        for r, c in zip(own, walk([r[2] for r in own], limit)):
            want[key, r[1]] = (c, r[2] > limit)
    assert got == want


def test_greedy_pack_of_nothing(spark):
    assert O.greedy_pack(spark.createDataFrame([], "k string, i int, n int"), ["k"], ["i"], "n", 5).count() == 0


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_running_sums_and_numbers(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["h", "h", "h", "x", None]), i, rng.choice([None, 1, -2, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    sums = {(r["k"], r["i"]): r["s"] for r in O.running_sum(df, ["k"], F.floor(F.col("i") / width), ["i"], F.col("v"), "s").collect()}
    numbers = {(r["k"], r["i"]): r["n"] for r in O.numbered(df, ["k"], F.floor(F.col("i") / width), ["i"], "n").collect()}
    for key in {r[0] for r in rows}:
        total = 0
        for n, (_, i, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1])):
            total += v or 0
            assert sums[key, i] == total and numbers[key, i] == n


def test_a_shuffle_depends_on_keys_and_seed_only(spark):
    df = spark.range(300)
    a = {r["id"]: r["p"] for r in O.shuffled(df, F.col("id"), 42, "p").collect()}
    b = {r["id"]: r["p"] for r in O.shuffled(df.orderBy(F.desc("id")).repartition(3), F.col("id"), 42, "p").collect()}
    c = {r["id"]: r["p"] for r in O.shuffled(df, F.col("id"), 43, "p").collect()}
    assert a == b != c and sorted(a.values()) == list(range(300))


def test_islands_partition_the_flagged_rows(spark):
    rng = random.Random(1)
    flags = [rng.choice([True, True, False, None]) for _ in range(400)]
    df = spark.createDataFrame([("u", i, f) for i, f in enumerate(flags)], "u string, i int, f boolean")
    got = sorted((r["span_start"], r["span_end"]) for r in O.islands(df, ["u"], F.floor(F.col("i") / 16), ["i"], F.col("f")).collect())
    covered = [i for a, b in got for i in range(a, b)]
    assert covered == [i for i, f in enumerate(flags) if f]
    assert all(a[1] < b[0] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("bucket", [16, 4096])
def test_recent_values(spark, bucket):
    df = spark.createDataFrame([("u", i, i % 13) for i in range(200)], "u string, pos int, v int")
    got = {r["pos"]: list(r["w"]) for r in O.with_recent(df, ["u"], "pos", "v", 10, "w", bucket).collect()}
    assert got == {i: [j % 13 for j in range(max(0, i - 10), i)] for i in range(200)}


@pytest.mark.parametrize("budget", [0, 50, 700])
def test_trimmed_context_against_a_loop(spark, budget):
    rng = random.Random(budget)
    rows = [(rng.choice([1, 1, 2]), i, rng.choice([0, 5, 30, 90, 2000, None, -4])) for i in range(300)]
    got = {(r["k"], r["i"]): (r["context_turns"], r["context_ms"]) for r in O.trimmed_context(spark.createDataFrame(rows, "k int, i int, n int"), ["k"], F.floor(F.col("i") / 8), ["i"], "n", budget).collect()}
    for key in (1, 2):
        past = []
        for _, i, n in (r for r in rows if r[0] == key):
            kept, total = 0, 0
            for m in reversed(past):
                if kept and total + m > budget:
                    break
                kept, total = kept + 1, total + m
            assert got[key, i] == (kept, total), (key, i)
            past.append(max(n or 0, 0))


@pytest.mark.parametrize("limit", [1, 7, 40, 1000])
def test_blocks_of_a_packing_join_to_one(limit):
    rng = np.random.default_rng(limit)
    for _ in range(60):
        sizes = rng.integers(1, rng.choice([3, limit + 3, 60]), rng.integers(1, 40))
        cuts = [0, *sorted(rng.integers(1, len(sizes) + 1, 3).tolist()), len(sizes)]
        blocks = [O.Packing.of(sizes[a:b], limit) for a, b in zip(cuts, cuts[1:]) if b > a]
        joined = blocks[0]
        for b in blocks[1:]:
            joined = joined.then(b)
        assert len(joined.lead) <= limit
        for fill in [0, *range(1, limit + 1, max(1, limit // 9)), limit + 5]:
            now, begun = fill, 0
            for n in sizes.tolist():
                if now and now + n <= limit:
                    now += n
                else:
                    begun, now = begun + 1, n
            assert joined.after(fill) == (now, begun)


@pytest.mark.parametrize("rows", [1, 3, 50])
def test_packing_in_small_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(O, "PACK_ROWS", rows)
    rng = random.Random(rows)
    data = [(rng.choice(["h", "h", "h", None, "x"]), i, rng.choice([1, 2, 5, 9, 30])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, i int, n int").repartition(5)
    got = {(r["k"], r["i"]): (r["chunk_no"], r["oversized"]) for r in O.greedy_pack(df, ["k"], ["i"], "n", 20).collect()}
    for key in ("h", "x", None):
        fill, chunk = 0, -1
        for _, i, n in (d for d in data if d[0] == key):
            if fill and fill + n <= 20:
                fill += n
            else:
                chunk, fill = chunk + 1, n
            assert got[key, i] == (chunk, n > 20)
