from __future__ import annotations

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmuro.llm import splits as S


def brute(pairs):
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
        up.setdefault(min(a, b), min(a, b))
    return {x: find(x) for x in up}


def graph(rng, kind):
    if kind == "sparse":
        return [(rng.randrange(900), rng.randrange(900)) for _ in range(500)]
    if kind == "path":
        order = list(range(300))
        rng.shuffle(order)
        return list(zip(order, order[1:]))
    if kind == "star":
        return [(10_000, i) for i in range(600)] + [(i, i) for i in range(5)] + [(None, 3), (4, None)]
    return [(rng.randrange(40), rng.randrange(40)) for _ in range(800)] * 2


@pytest.mark.parametrize("held", [10, 150, 1_000_000])
@pytest.mark.parametrize("kind", ["sparse", "path", "star", "dense"])
def test_components(spark, kind, held):
    pairs = graph(random.Random(kind), kind)
    got = S.components(spark.createDataFrame(pairs, "a long, b long").repartition(5), held)
    assert {r["node"]: r["root"] for r in got.collect()} == brute(pairs)
    assert got.count() == len(brute(pairs))


def one_by_one(sizes, targets):
    have, out = [0.0] * len(targets), []
    for size, n in sizes:
        got = Counter()
        for _ in range(n):
            at = max(range(len(targets)), key=lambda i: (targets[i] - have[i], -i))
            have[at] += size
            got[at] += 1
        out.append(got)
    return have, out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=8))
def test_dealing_by_size_is_dealing_group_by_group(hist):
    sizes = sorted(hist.items(), reverse=True)
    total = sum(s * n for s, n in sizes)
    targets = [total * p for p in (0.8, 0.13, 0.07)]
    _, want = one_by_one(sizes, targets)
    got = [Counter(dict(x)) for x in S.deal(sizes, targets)]
    assert [sum(x.values()) for x in got] == [n for _, n in sizes]
    for (size, _), a, b in zip(sizes, got, want):
        assert all(abs(a[i] - b[i]) <= 1 for i in range(3)), size


SEGMENTS = "source_dataset_id long, segment_id int, speaker_id int, node string, root string, row_id string, split string, size string"
META = "shard_file string, sample_key string, row_id long, seq_id int, source_dataset_id long, segment_id int, model string, node string, root string, n_records string, split string"


def tables(spark):
    seg = [(i, 0, [None, 0, 0][i % 3]) for i in range(400)] + [(1, 1, 5), (2, 1, 5), (3, 1, 6), (2, 2, 6), (None, 1, 5), (9, 1, 77)]
    seg += [(500, i, 0) for i in range(300)]
    meta = [("shards/m/train/a.tar", f"{i:08d}_00000", i, 0, i, 0, "m") for i in range(50)]
    meta += [("shards/m/train/a.tar", "00000010_00007", None, None, 11, 0, "m"), ("shards/m/train/a.tar", "x", None, None, None, 0, None)]
    return spark.createDataFrame([(*r, *"abcde") for r in seg], SEGMENTS), spark.createDataFrame([(*r, *"abcd") for r in meta], META)


def test_linked_recordings(spark):
    got = {(r["row_id"], r["group_row_id"]) for r in S.linked_recordings(*tables(spark)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (10, 10), (11, 10)}


def test_splits_keep_groups_whole_and_near_their_targets(spark):
    out = S.recording_splits(*tables(spark), (("train", 0.6), ("validation", 0.2), ("test", 0.2))).collect()
    assert len(out) == len({r["row_id"] for r in out}) == 401
    by_group: dict = {}
    for r in out:
        by_group.setdefault(r["group_row_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by_group.values())
    n = Counter()
    for r in out:
        n[r["split"]] += r["n_records"]
    total = sum(n.values())
    assert abs(n["train"] / total - 0.6) < 0.02 and abs(n["test"] / total - 0.2) < 0.02


def test_many_groups_of_one_size_are_numbered_in_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "NUMBERED", 50)
    got = S.assign(spark.range(1000).select(F.col("id").alias("group"), F.lit(1).cast("long").alias("size")), (("a", 0.5), ("b", 0.5)))
    assert got.groupBy("split").count().collect() and sorted(r["count"] for r in got.groupBy("split").count().collect()) == [500, 500]


def test_empty(spark):
    seg, meta = tables(spark)
    assert S.linked_recordings(seg.limit(0), meta.limit(0)).count() == 0
    assert S.recording_splits(seg.limit(0), meta.limit(0)).count() == 0
