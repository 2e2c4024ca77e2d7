"""Train, validation and test splits that keep linked records together.

Links are resolved by union-find: every task builds the forest of its own links, and forests are merged
over fewer and fewer tasks for as long as one task can hold its share. Where they don't shrink enough
for that, rounds of star contraction on the whole cluster finish the work. Groups are then given to
splits, largest first, each to the split furthest below its target; groups of the same size are given
out together, so the driver handles distinct sizes, not groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.operators.compaction import shard_records
from murmuro.session import cut, store

#: Links that one task holds. A memory bound, about 500 bytes a link.
HELD_LINKS = 1_000_000
#: Groups of one size that one task numbers.
NUMBERED = 1_000_000
#: Speakers are nodes above all recordings, so the smallest node of a group is a recording.
SPEAKERS = 1 << 61
SPLITS = (("train", 0.9), ("validation", 0.05), ("test", 0.05))


class Links:
    """Union-find in which the smallest node is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            above = up[x]
            up[x] = root
            x = above
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a < b:
            self.up[b] = a
        elif b < a:
            self.up[a] = b


def _forest(held: int):
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def passed(links: Links) -> Iterator[pa.RecordBatch]:
        nodes = list(links.up)
        roots = [links.find(x) for x in nodes]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                links.join(a, b)
            if len(links.up) > held:
                yield from passed(links)
                links = Links()
        yield from passed(links)

    return run


def forest(links: DataFrame, held: int = HELD_LINKS) -> DataFrame:
    """The forest of each partition's links: (node, root), fewer rows than the partition has nodes."""
    return links.mapInArrow(_forest(held), "node long, root long")


def components(links: DataFrame, held: int = HELD_LINKS) -> DataFrame:
    """(node, root) for every node of links (two long columns); root is the smallest node that it is linked to.

    Null ends and links of a node to itself say nothing and are left out; so a node without a link to
    another isn't in the result.
    """
    a, b = links.columns
    clean = links.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("root")).where("node <> root")
    level = cut(forest(clean, held))
    n = level.count()
    while True:
        tasks = max(1, math.ceil(n / held))
        if tasks >= level.rdd.getNumPartitions() > 1:
            level = _stars(level)
            break
        level = cut(forest(level.coalesce(tasks), held))
        if tasks == 1:
            break
        shrunk = level.count()
        if shrunk > 0.7 * n:
            level = _stars(level)
            break
        n = shrunk
    roots = level.select(F.col("root").alias("node"), "root").distinct()
    return level.unionByName(roots)


def _stars(links: DataFrame) -> DataFrame:
    """Large and small stars by turns until each node hangs from the smallest of its group.

    Minima are taken with partial aggregation; the join back is one row per node against its links, so
    the links of a node with very many of them are split by adaptive execution.
    """
    now, seen = links.select("node", "root").distinct(), None
    while True:
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("m"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("m").alias("root"))
        large = large.where("node <> root").distinct()
        down = large.select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root"))
        low = down.groupBy("node").agg(F.min("root").alias("m"))
        small = down.join(low, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).unionByName(low.select("node", F.col("m").alias("root")))
        now = cut(small.where("node <> root").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if state == seen:
            return now
        seen = state


def recording_links(segments: DataFrame, meta: DataFrame) -> DataFrame:
    """Links of recordings by speaker_id (null and 0 aren't speakers) and by shard records under another's row_id."""
    said = segments.where("speaker_id <> 0 and source_dataset_id is not null").select(F.col("source_dataset_id").cast("long").alias("a"), (F.lit(SPEAKERS) + F.col("speaker_id")).alias("b")).distinct()
    moved = shard_records(meta).where("row_id <> source_dataset_id").select(F.col("row_id").alias("a"), F.col("source_dataset_id").alias("b")).distinct()
    return said.unionByName(moved)


def linked_recordings(segments: DataFrame, meta: DataFrame) -> DataFrame:
    """(row_id, group_row_id) of the recordings that are linked to at least one other."""
    found = components(recording_links(segments, meta)).where(F.col("node") < SPEAKERS)
    several = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    return found.join(several, "root", "left_semi").select(F.col("node").alias("row_id"), F.col("root").alias("group_row_id"))


# -------------------------------------------------------------------- assignment


def deal(sizes: Sequence[tuple[int, int]], targets: Sequence[float]) -> list[list[tuple[int, int]]]:
    """For each (size, number of groups), largest size first: how many groups go to which split, in order.

    The result is that of giving out group by group, each to the split whose target is furthest above
    what it has (the first of several). Groups of one size are given out by level: a split gets groups
    until it is no further below its target than the others.
    """
    have, out = [0.0] * len(targets), []
    for size, n in sizes:
        below = [t - h for t, h in zip(targets, have)]
        lo, hi = min(below) - size * (n + 1), max(below)
        for _ in range(200):
            mid = (lo + hi) / 2
            if sum(max(0, math.ceil((b - mid) / size)) for b in below) > n:
                lo = mid
            else:
                hi = mid
        got = [max(0, math.ceil((b - hi) / size)) for b in below]
        while sum(got) > n:
            got[got.index(max(got))] -= 1
        for _ in range(n - sum(got)):
            at = max(range(len(targets)), key=lambda i: (below[i] - got[i] * size, -i))
            got[at] += 1
        have = [h + g * size for h, g in zip(have, got)]
        out.append([(i, g) for i, g in enumerate(got) if g])
    return out


def assign(groups: DataFrame, splits: Sequence[tuple[str, float]] = SPLITS) -> DataFrame:
    """Adds split to groups (group long, size long): the given shares of all sizes, whole groups only.

    The driver gets one row per distinct size: of N records there are fewer than the square root of
    2 N. Within a size, groups are numbered in the order of a hash.
    """
    spark = groups.sparkSession
    groups = store(groups, "groups")
    hist = sorted(((r["size"], r["n"]) for r in groups.where("size > 0").groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total = sum(s * n for s, n in hist)
    share = sum(p for _, p in splits)
    dealt = deal(hist, [total * p / share for _, p in splits])
    ranges, buckets = [], []
    for (size, n), parts in zip(hist, dealt):
        at = 0
        for i, k in parts:
            ranges.append((size, at, at + k, splits[i][0]))
            at += k
        buckets.append((size, max(1, math.ceil(n / NUMBERED))))
    plan = spark.createDataFrame(ranges, "size long, low long, high long, split string")
    cells = spark.createDataFrame(buckets, "size long, cells int")
    placed = groups.join(cells, "size").withColumn("h", F.xxhash64("group")).withColumn("cell", F.pmod(F.col("h"), F.col("cells")).cast("int"))
    before = _before(placed.where("cells > 1"), spark)
    numbered = placed.selectExpr("*", "row_number() over (partition by size, cell order by h, group) - 1 as k").join(before, ["size", "cell"], "left").withColumn("k", F.col("k") + F.coalesce("before", F.lit(0)))
    return numbered.join(plan, "size").where("k >= low and k < high").select("group", "size", "split")


def _before(placed: DataFrame, spark: SparkSession) -> DataFrame:
    counts = sorted((r["size"], r["cell"], r["n"]) for r in placed.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("n")).collect())
    rows, last, run = [], None, 0
    for size, cell, n in counts:
        run = 0 if size != last else run
        rows.append((size, cell, run))
        last, run = size, run + n
    return spark.createDataFrame(rows, "size long, cell int, before long")


def recording_splits(segments: DataFrame, meta: DataFrame, splits: Sequence[tuple[str, float]] = SPLITS) -> DataFrame:
    """(row_id, group_row_id, n_records, split) of every recording of both tables.

    Every stored row of segments and shard_meta is a record. Rows that name no recording aren't in
    any group. Empty tables give no rows.
    """
    sizes = store(
        segments.select(F.col("source_dataset_id").cast("long").alias("row_id"))
        .unionByName(shard_records(meta).select("row_id"))
        .where("row_id is not null").groupBy("row_id").agg(F.count(F.lit(1)).alias("n_records")),
        "sizes",
    )
    groups = components(recording_links(segments, meta)).where(F.col("node") < SPEAKERS)
    of = store(sizes.join(groups, sizes["row_id"] == groups["node"], "left").select("row_id", "n_records", F.coalesce("root", "row_id").alias("group_row_id")), "recordings")
    dealt = assign(of.groupBy(F.col("group_row_id").alias("group")).agg(F.sum("n_records").alias("size")), splits)
    return of.join(dealt.select(F.col("group").alias("group_row_id"), "split"), "group_row_id").select("row_id", "group_row_id", "n_records", "split")

