"""Windows of fixed capacity, filled by multiway differencing.

Items start as partial partitions of their own. The two partitions with the largest imbalance are
merged, the larger sums of one on the smaller of the other, until one is left; its parts are near equal.
If one exceeds the capacity, the number of windows rises by one. Items are dealt to blocks of bounded
size by a hash, and blocks are packed independently.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuro.session import store

#: Windows of a block, about: the number of parts that differencing handles at once.
BLOCK_WINDOWS = 64
#: Frames of a window.
WINDOW_FRAMES = 2048


def differencing(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each item, of near equal sums.

    A partial partition has its sums in descending order, zeros left out. An item is a partition of one sum;
    it lands on a zero of the partition it is merged with, where that has one, which is a plain append, so
    only partitions without zeros, about one in parts items, take a merge of all their sums.
    """
    n = len(sizes)
    if n <= parts:
        return np.arange(n)
    order = np.argsort(-sizes, kind="stable").tolist()
    size = sizes.tolist()
    children: list[tuple[int, int]] = []
    heap: list[tuple[int, int, list[int], list[int]]] = []
    turn = at = 0

    def taken() -> tuple[list[int], list[int]]:
        """The partition with the largest imbalance."""
        nonlocal at
        if at < n and (not heap or size[order[at]] >= -heap[0][0]):
            at += 1
            return [size[order[at - 1]]], [order[at - 1]]
        return heapq.heappop(heap)[2:]

    def merged(a: tuple[list[int], list[int]], b: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
        """The larger sums of one on the smaller of the other."""
        (a_sums, a_nodes), (b_sums, b_nodes) = a, b
        free = parts - len(a_sums)
        if len(b_sums) <= free and (not b_sums or a_sums[-1] >= b_sums[0]):
            return a_sums + b_sums, a_nodes + b_nodes
        sums, nodes = a_sums + [0] * free, a_nodes + [-1] * free
        for place, (x, node) in enumerate(zip(b_sums, b_nodes)):
            i = parts - 1 - place
            sums[i] += x
            if nodes[i] >= 0:
                children.append((nodes[i], node))
                node = n + len(children) - 1
            nodes[i] = node
        ranked = sorted((i for i in range(parts) if nodes[i] >= 0), key=lambda i: -sums[i])
        return [sums[i] for i in ranked], [nodes[i] for i in ranked]

    while True:
        a = taken()
        if at == n and not heap:
            break
        sums, nodes = merged(a, taken())
        heapq.heappush(heap, ((sums[-1] if len(sums) == parts else 0) - sums[0], turn, sums, nodes))
        turn += 1
    out = np.zeros(n, np.int64)
    for part, root in enumerate(a[1]):
        stack = [root]
        while stack:
            node = stack.pop()
            if node < n:
                out[node] = part
            else:
                stack.extend(children[node - n])
    return out


def fewest(sizes: np.ndarray, capacity: int) -> int:
    """Windows that are needed at least: items over half a window keep apart, and beside each of them there is only so much room for the smaller ones (for every size from which on they count as such)."""
    ordered = np.sort(sizes)
    total = np.concatenate(([0], np.cumsum(ordered)))
    half = int(np.searchsorted(ordered, capacity / 2, "right"))
    best = -(-int(total[-1]) // capacity)
    for small in np.unique(ordered[:half]).tolist() or [1]:
        lone = int(np.searchsorted(ordered, capacity - small, "right"))  # no item of small or more fits beside these
        first = int(np.searchsorted(ordered, small))
        room = (lone - half) * capacity - int(total[lone] - total[half])
        rest = int(total[half] - total[first]) - room
        best = max(best, len(ordered) - half + max(0, -(-rest // capacity)))
    return max(1, best)


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, none over capacity (no item may be): the number of windows rises from the least possible until differencing keeps to the capacity."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    k = fewest(sizes, capacity)
    while True:
        found = differencing(sizes, k)
        if np.bincount(found, sizes).max() <= capacity:
            return found
        k += 1


def pack(items: DataFrame, group: str, ident: Sequence[str], size: str, capacity: int = WINDOW_FRAMES) -> DataFrame:
    """Columns group, ident, part_no, window (unique over all groups), window_start, size.

    items has one row per item. Items of different groups share no window. An item over capacity is
    split into parts that fill a window and one that is packed like an item; others stay whole. Null,
    zero and negative sizes need no window and have no row. Ties and repeated rows are items like others.
    Blocks are dealt by a hash of the items' ids and of their place in the stored table, so that blocks are
    of one size even where ids are null or repeated.
    """
    ident = list(ident)
    exact = [items.schema[c].dataType for c in (group, *ident)]
    # as text: a nullable integer would reach pandas as a float
    rows = items.select(*[F.col(c).cast("string").alias(c) for c in (group, *ident)], F.col(size).cast("long").alias("__size")).where("__size > 0")
    parts = rows.withColumn("part_no", F.explode(F.sequence(F.lit(0), ((F.col("__size") - 1) / capacity).cast("int")))).withColumn("__size", F.least(F.lit(capacity).cast("long"), F.col("__size") - F.col("part_no") * capacity))
    parts = store(parts.withColumn("__n", F.monotonically_increasing_id()), "parts")  # read three times below
    name = F.concat_ws("/", F.coalesce(F.col(group).cast("string"), F.lit("none")), *[F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ident])
    full = parts.where(F.col("__size") == capacity).select(group, *ident, "part_no", F.concat_ws("/", F.lit("full"), name, F.col("part_no")).alias("window"), F.lit(0).cast("long").alias("window_start"), F.col("__size").alias(size))
    rest = parts.where(F.col("__size") < capacity)
    totals = rest.groupBy(F.col(group).alias("__group")).agg(F.greatest(F.lit(1), F.ceil(F.sum("__size") / (capacity * BLOCK_WINDOWS))).cast("int").alias("__blocks"))
    dealt = rest.join(totals, F.col(group).eqNullSafe(F.col("__group"))).withColumn("__block", F.pmod(F.xxhash64(*ident, "part_no", "__n"), F.col("__blocks")).cast("int")).drop("__group", "__blocks", "__n")
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in (group, *ident)], T.StructField("part_no", T.IntegerType()), T.StructField("window", T.StringType()), T.StructField("window_start", T.LongType()), T.StructField(size, T.LongType())])

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*ident, "part_no"], kind="stable")
        pdf["__w"] = windows_of(pdf["__size"].to_numpy(np.int64), capacity)
        head = f"{'none' if pd.isna(pdf[group].iloc[0]) else pdf[group].iloc[0]}/{int(pdf['__block'].iloc[0]):06d}"
        pdf["window"] = [f"{head}/{w:05d}" for w in pdf["__w"]]
        pdf["window_start"] = pdf.groupby("__w")["__size"].cumsum() - pdf["__size"]
        return pdf.rename(columns={"__size": size})[schema.names]

    out = full.unionByName(dealt.groupBy(group, "__block").applyInPandas(packed, schema))
    return out.withColumns({c: F.col(c).cast(t) for c, t in zip((group, *ident), exact)})
