"""Order-dependent operators that need no task to see a whole group.

A group may hold a third of all rows, so none of these sorts one in a single task. The caller names a
bucket, a coarse form of the order (say, sequence number div 65536): rows of lower buckets come first.
Work is done within (group, bucket), and one small row per bucket carries what came before. Where no such
form is known, the rows are sorted over the whole cluster and the buckets are the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from murmuro.session import cut


def running_sum(df: DataFrame, by: Sequence[str], bucket: Column | None, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Adds out, the sum of value over the rows of the group up to and with each row.

    bucket: see above; None for a global sort. Nulls add nothing. Rows that tie in order and bucket are
    summed in any order among themselves.
    """
    by = list(by)
    rows = df.withColumn("__value", F.coalesce(value, F.lit(0)))
    if bucket is None:
        rows = cut(rows.repartitionByRange(*by, *order).withColumn("__bucket", F.spark_partition_id()))
    else:
        rows = rows.withColumn("__bucket", bucket)
    within = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("__sum", F.sum("__value").over(within))
    totals = rows.groupBy(*by, "__bucket").agg(F.sum("__value").alias("__total"))
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__bucket").alias("__at"), F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    same = F.col("__bucket").eqNullSafe(F.col("__at"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return summed.join(before, same).withColumn(out, F.col("__sum") + F.col("__before")).select(*df.columns, out)


def numbered(df: DataFrame, by: Sequence[str], bucket: Column | None, order: Sequence[str], out: str) -> DataFrame:
    """Adds out, each row's number within its group, from 0."""
    return running_sum(df, by, bucket, order, F.lit(1).cast("long"), "__n").withColumn(out, F.col("__n") - 1).drop("__n")


def shuffled(df: DataFrame, key: Column, seed: int, out: str, digits: int = 3) -> DataFrame:
    """Adds out, each row's place (from 0) in a shuffle that depends on the seed and the keys only.

    The order is that of md5(seed:key), then key; buckets are the hash's first digits, 16 ** digits of them.
    """
    mixed = df.withColumns({"__key": key.cast("string"), "__md5": F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))})
    return numbered(mixed, [], F.substring("__md5", 1, digits), ["__md5", "__key"], out).drop("__key", "__md5")


#: Rows of a group in a bucket where rows are numbered.
POSITIONS = 65_536


def islands(df: DataFrame, by: Sequence[str], bucket: Column | None, order: Sequence[str], flag: Column) -> DataFrame:
    """Runs of flagged rows: by, span_start, span_end (half-open row numbers within the group). A null flag is false. bucket: as of running_sum."""
    by = list(by)
    raised = F.coalesce(flag, F.lit(False))
    at = numbered(df.withColumn("__flag", raised.cast("int")), by, bucket, order, "__pos")
    run = running_sum(at, by, F.floor(F.col("__pos") / POSITIONS), ["__pos"], 1 - F.col("__flag"), "__run")
    return run.where("__flag = 1").groupBy(*by, "__run").agg(F.min("__pos").alias("span_start"), (F.max("__pos") + 1).alias("span_end")).drop("__run")


def with_recent(df: DataFrame, by: Sequence[str], position: str, value: str, n: int, out: str, bucket: int = 4096) -> DataFrame:
    """Adds out, the array of value in the n rows before each row. position numbers the rows of a group from 0 without gaps.

    Each bucket of positions also gets the last n rows of the one before.
    """
    by = list(by)
    at = F.floor(F.col(position) / bucket)
    near_end = F.pmod(F.col(position), F.lit(bucket)) >= bucket - n
    placed = df.withColumn("__home", at).withColumn("__bucket", F.explode(F.when(near_end, F.array(at, at + 1)).otherwise(F.array(at))))
    w = Window.partitionBy(*by, "__bucket").orderBy(position).rowsBetween(-n, -1)
    return placed.withColumn(out, F.collect_list(value).over(w)).where(F.col("__home") == F.col("__bucket")).drop("__home", "__bucket")


def trimmed_context(df: DataFrame, by: Sequence[str], bucket: Column | None, order: Sequence[str], length_ms: str, budget_ms: int) -> DataFrame:
    """For each turn the newest earlier turns of its group that fit a budget together: context_turns, context_ms.

    The turn just before always belongs to it, however long. Null and negative lengths count as 0 ms.
    """
    by = list(by)
    clean = F.greatest(F.coalesce(F.col(length_ms).cast("long"), F.lit(0)), F.lit(0))
    rows = df.withColumns({"__len": clean, "__b": bucket})
    up_to = running_sum(numbered(rows, by, F.col("__b"), order, "__no"), by, F.col("__b"), order, F.col("__len"), "__end")
    timed = up_to.withColumn("__start", F.col("__end") - F.col("__len"))
    width = max(budget_ms, 1) * 16
    home = F.floor(F.col("__start") / width)
    placed = timed.withColumn("__home", home).withColumn("__at", F.explode(F.sequence(home, F.floor((F.col("__end") + budget_ms) / width))))
    key = [*by, "__at"]
    fits = Window.partitionBy(*key).orderBy("__start").rangeBetween(-budget_ms, 0)
    order_in = Window.partitionBy(*key).orderBy("__start", "__no")
    seen = placed.withColumns({"__first": F.min("__no").over(fits), "__from": F.min("__start").over(fits), "__before": F.lag("__len").over(order_in)}).where("__home = __at")
    n = F.col("__no") - F.col("__first")
    alone = (n == 0) & (F.col("__no") > 0)
    return seen.select(*df.columns, F.when(alone, F.lit(1).cast("long")).otherwise(n).alias("context_turns"), F.when(alone, F.col("__before")).otherwise(F.col("__start") - F.col("__from")).alias("context_ms"))


# ------------------------------------------------------------------ greedy packing


def greedy_pack(df: DataFrame, by: Sequence[str], order: Sequence[str], length: str, limit: int) -> DataFrame:
    """Packs consecutive rows of a group up to a limit (inclusive): adds chunk_no (from 0) and oversized.

    A row over the limit is marked oversized and is a chunk of its own. Rows with a null length are left
    out. Rows are sorted over the whole cluster, and each partition is looked at in blocks of PACK_ROWS. A
    block doesn't know how full the chunk is that reaches into it, so it works out, for each place
    where that chunk may end, how full the last one is and how many there are (at most the rows whose
    lengths together keep to the limit); blocks of a partition are joined to one such table while it is
    read. The driver follows the tables, at most one of the limit's length a partition, from partition
    to partition, and a second scan numbers the chunks.
    """
    by, order = list(by), list(order)
    key = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in by]) if by else F.lit("")
    rows = df.where(F.col(length).isNotNull()).withColumns({"__key": key, "__len": F.greatest(F.col(length).cast("long"), F.lit(1))})
    ordered = cut(rows.repartitionByRange("__key", *order).sortWithinPartitions("__key", *order).withColumn("__part", F.spark_partition_id()))
    found = sorted(ordered.select("__part", "__key", "__len").mapInArrow(_pack_tables(limit, PACK_ROWS), "part int, first_key string, last_key string, lead array<long>, fill array<long>, chunks array<long>").collect(), key=lambda r: r["part"])
    carried, at, fill, chunk = {}, None, 0, -1
    for r in found:
        if r["first_key"] != at:
            fill, chunk = 0, -1
        carried[r["part"]] = (fill, chunk)
        if r["first_key"] == r["last_key"]:
            fill, more = Packing(limit, r["lead"], r["fill"], r["chunks"]).after(fill)
            chunk += more
        else:
            fill, chunk = r["fill"][0], r["chunks"][0] - 1
        at = r["last_key"]
    schema = T.StructType([*df.schema.fields, T.StructField("chunk_no", T.LongType()), T.StructField("oversized", T.BooleanType())])
    return ordered.mapInArrow(_pack_rows(carried, limit, len(df.columns), to_arrow_schema(schema)), schema)


#: Rows of a partition that greedy_pack works out at once.
PACK_ROWS = 65_536


class Packing:
    """What consecutive rows make of a chunk that reaches into them.

    lead: the rows' lengths summed up, as far as the limit. fill and chunks have one entry more than lead:
    with k of the rows in the chunk that reaches in, how full the last chunk is and how many were begun.
    Where none was begun, fill is what the rows added.
    """

    def __init__(self, limit: int, lead: Sequence[int], fill: Sequence[int], chunks: Sequence[int]) -> None:
        self.limit, self.lead, self.fill, self.chunks = limit, np.asarray(lead, np.int64), np.asarray(fill, np.int64), np.asarray(chunks, np.int64)

    @classmethod
    def of(cls, size: np.ndarray, limit: int) -> Packing:
        total = np.concatenate(([0], np.cumsum(size)))
        n = len(size)
        lead = total[1 : 1 + int(np.searchsorted(total[1:], limit, "right"))]
        after = np.maximum(np.searchsorted(total, total[:-1] + limit, "right") - 1, np.arange(1, n + 1)).tolist()
        fill, chunks = [0] * n + [int(total[n])], [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            j = after[i]
            fill[i], chunks[i] = (fill[j], chunks[j] + 1) if j < n else (int(total[n] - total[i]), 1)
        k = len(lead) + 1
        return cls(limit, lead, fill[:k], chunks[:k])

    def after(self, fill: int) -> tuple[int, int]:
        """How full the last chunk is and how many were begun, after a chunk that is fill full (0: none) reached in."""
        at = int(np.searchsorted(self.lead, self.limit - fill, "right")) if fill else 0
        begun = int(self.chunks[at])
        return int(self.fill[at]) + (0 if begun or not fill else fill), begun

    def then(self, other: Packing) -> Packing:
        """Both, one after the other."""
        whole = len(self.lead) and len(self.chunks) > len(self.lead) and self.chunks[-1] == 0  # all rows may be in the chunk
        fill, chunks = [], []
        for f, c in zip(self.fill.tolist(), self.chunks.tolist()):
            if c:
                g, d = other.after(f)
                fill.append(g)
                chunks.append(c + d)
        if not whole:
            return Packing(self.limit, self.lead, fill, chunks)
        base = int(self.lead[-1])
        more = other.lead[other.lead <= self.limit - base] + base
        k = len(more) + 1
        fill += [f + (0 if c else base) for f, c in zip(other.fill[:k].tolist(), other.chunks[:k].tolist())]
        return Packing(self.limit, np.concatenate((self.lead, more)), fill, chunks + other.chunks[:k].tolist())


def _pack_tables(limit: int, at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = key = None
        known: Packing | None = None  # of the rows of key so far, where all rows are key's
        fill, chunk, alone = 0, -1, True
        waiting: list[np.ndarray] = []

        def settle() -> None:
            nonlocal known, waiting
            if waiting:
                block = Packing.of(np.concatenate(waiting), limit)
                known, waiting = block if known is None else known.then(block), []

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sizes = batch.column("__key"), batch.column("__len").to_numpy()
            runs = pa.compute.run_end_encode(keys)
            lo = 0
            for name, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if first is None:
                    part, first, key = batch.column("__part")[0].as_py(), name, name
                if name != key:
                    key, alone, waiting, known, fill, chunk = name, False, [], None, 0, -1
                for at in range(lo, hi, at_once):
                    block = sizes[at : min(hi, at + at_once)]
                    if alone:
                        waiting.append(block)
                        if sum(map(len, waiting)) >= at_once:
                            settle()
                    else:
                        for n in block.tolist():
                            if fill and fill + n <= limit:
                                fill += n
                            else:
                                chunk, fill = chunk + 1, n
                lo = hi
        if first is None:
            return
        settle()
        lead, fills, chunks = (known.lead.tolist(), known.fill.tolist(), known.chunks.tolist()) if alone else ([], [fill], [chunk + 1])
        kinds = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        row = (part, first, key, lead, fills, chunks)
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["part", "first_key", "last_key", "lead", "fill", "chunks"])

    return run


def _pack_rows(carried: dict[int, tuple[int, int]], limit: int, width: int, kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fill, chunk = None, 0, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, lengths = batch.column("__key").to_pylist(), batch.column("__len").to_pylist()
            if key is None:
                key = keys[0]
                fill, chunk = carried[batch.column("__part")[0].as_py()]
            numbers = []
            for k, n in zip(keys, lengths):
                if k != key:
                    key, fill, chunk = k, 0, -1
                if fill and fill + n <= limit:
                    fill += n
                else:
                    chunk, fill = chunk + 1, n
                numbers.append(chunk)
            added = [pa.array(numbers, pa.int64()), pa.array([n > limit for n in lengths])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *added], schema=kinds)

    return run
