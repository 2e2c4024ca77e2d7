from __future__ import annotations

import heapq

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmuro.llm import packing as P
from murmuro.operators.compaction import first_fit_decreasing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 9))
def test_differencing_places_every_item_and_balances(sizes, parts):
    sizes = np.array(sizes)
    sums = np.bincount(P.differencing(sizes, parts), sizes, parts)
    assert sums.sum() == sizes.sum()
    assert sums.max() - sums.min() <= sizes.max() * 2
    assert sums.max() >= sizes.sum() / parts


def test_differencing_of_two_parts_is_the_textbook_case():
    sizes = np.array([8, 7, 6, 5, 4])
    assert sorted(np.bincount(P.differencing(sizes, 2), sizes)) == [14, 16]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_windows_hold_and_are_few(sizes):
    sizes = np.array(sizes, np.int64)
    found = P.windows_of(sizes, 100)
    if len(sizes):
        assert np.bincount(found, sizes).max() <= 100
        used, simple = len(set(found.tolist())), int(first_fit_decreasing(sizes, 100).max()) + 1
        assert P.fewest(sizes, 100) <= simple and P.fewest(sizes, 100) <= used <= 1.25 * simple + 2


def plainly(sizes, parts):
    """Differencing by its definition: sums only, all zeros kept."""
    heap = [(-x, i, [x] + [0] * (parts - 1)) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    for turn in range(len(heap), 2 * len(heap) - 1):
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        c = sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)
        heapq.heappush(heap, (c[-1] - c[0], turn, c))
    return heap[0][2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=10, max_size=60, unique=True), st.integers(2, 9))
def test_appending_to_zeros_is_the_same_as_merging(sizes, parts):
    got = np.bincount(P.differencing(np.array(sizes), parts), sizes, parts)
    assert sorted(got.astype(int).tolist(), reverse=True) == plainly(sizes, parts)


def test_usual_blocks_need_no_more_than_first_fit_decreasing():
    for seed in range(5):
        sizes = np.random.default_rng(seed).lognormal(4, 0.7, 1600).astype(np.int64) + 1
        assert len(set(P.windows_of(sizes, 2048).tolist())) <= first_fit_decreasing(sizes, 2048).max() + 1


def test_one_id_of_many_items_is_dealt_to_many_blocks(spark):
    df = spark.createDataFrame([("a", None, None, 30, "", "", "")] * 40_000, SCHEMA)
    out = P.pack(df, "model", ["row_id", "seq_id"], "frames", 2048)
    assert out.count() == 40_000
    blocks = [r["count"] for r in out.groupBy(F.substring_index("window", "/", 2)).count().collect()]
    assert len(blocks) >= 9 and max(blocks) < 40_000 / 5


def test_usual_items_fill_windows():
    sizes = np.random.default_rng(1).lognormal(4, 0.7, 1600).astype(np.int64) + 1
    used = len(set(P.windows_of(sizes, 2048).tolist()))
    assert sizes.sum() / (used * 2048) > 0.975


SCHEMA = "model string, row_id long, seq_id int, frames int, window string, part_no string, __block string"


def test_all_items_whole_unless_oversized(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_WINDOWS", 4)
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else "b", i, 0, int(rng.integers(-5, 260))) for i in range(800)]
    rows += [(None, 1, None, 30), ("b", None, 1, 100), ("b", None, 2, None), ("b", 7, 3, 1000), ("b", 8, 3, 1050)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    out = P.pack(df, "model", ["row_id", "seq_id"], "frames", 100).collect()
    sums, parts = {}, {}
    for r in out:
        sums.setdefault(r["window"], []).append((r["window_start"], r["frames"], r["model"]))
        parts.setdefault((r["model"], r["row_id"], r["seq_id"]), []).append(r["frames"])
    want = {r[:3]: r[3] for r in rows if r[3] and r[3] > 0}
    assert {k: sum(v) for k, v in parts.items()} == want
    assert all(len(v) == -(-want[k] // 100) for k, v in parts.items())
    for inside in sums.values():
        assert sum(n for _, n, _ in inside) <= 100 and len({m for _, _, m in inside}) == 1
        at = 0
        for start, n, _ in sorted(inside):
            assert start == at
            at += n


def test_repeated_rows_are_items_and_empty_is_empty(spark):
    df = spark.createDataFrame([("a", 1, 1, 60, "", "", "")] * 3, SCHEMA)
    out = P.pack(df, "model", ["row_id", "seq_id"], "frames", 100).collect()
    assert len(out) == 3 and len({r["window"] for r in out}) == 3
    assert P.pack(df.limit(0), "model", ["row_id", "seq_id"], "frames", 100).count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_few_items(n):
    assert P.windows_of(np.full(n, 5, np.int64), 10).tolist() == [0] * n


def test_large_and_null_ids(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([("a", big, 1, 5, "", "", ""), ("a", None, None, 5, "", "", "")], SCHEMA)
    assert {r["row_id"] for r in P.pack(df, "model", ["row_id", "seq_id"], "frames", 100).collect()} == {big, None}
