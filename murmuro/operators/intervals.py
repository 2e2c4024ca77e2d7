"""Continuous periods and gaps of time intervals, for entities of any size.

The intervals are sorted by entity and start over the whole cluster, so one entity may lie in many
partitions. Each partition is summed up by its first and last entity, the island open at its end and
the largest end seen; the driver combines these summaries in order (one small row per partition), and
a second scan of each partition starts from the state that its predecessors leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuro.session import cut

NONE = np.iinfo(np.int64).min
LIMIT_MS = 9.0e15


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds; null for null, NaN and what no clock can show."""
    return F.when(F.abs(seconds) < LIMIT_MS / 1000, F.round(seconds * 1000).cast("long"))


def valid_segments(segments: DataFrame) -> DataFrame:
    """Adds start_ms and end_ms and keeps the rows whose end lies after their start."""
    start, end = to_ms(F.col("start_sec")), to_ms(F.col("end_sec"))
    return segments.where(end > start).withColumns({"start_ms": start, "end_ms": end})


@dataclass(frozen=True)
class Open:
    """The island that is open after some row."""

    key: str
    start: int
    end: int
    ident: tuple


@dataclass(frozen=True)
class Summary:
    first_key: str
    first_start: int
    last: Open


def _scan(batches: Iterator[pd.DataFrame], state: Open | None, ids: list[str]) -> Iterator[tuple[pd.DataFrame | None, Open | None]]:
    """For each batch the periods that closed and the gaps, and the island left open."""
    for pdf in batches:
        if not len(pdf):
            continue
        key, start, end = pdf["__key"].to_numpy(object), pdf["__start"].to_numpy(np.int64), pdf["__end"].to_numpy(np.int64)
        fresh = np.empty(len(pdf), bool)
        fresh[0] = state is None or state.key != key[0]
        fresh[1:] = key[1:] != key[:-1]
        top = pd.Series(end).groupby(np.cumsum(fresh)).cummax().to_numpy().copy()
        if not fresh[0]:
            first = np.flatnonzero(fresh)
            upto = first[0] if len(first) else len(pdf)
            np.maximum(top[:upto], state.end, out=top[:upto])
        before = np.concatenate(([state.end if state else NONE], top[:-1]))
        begins = np.flatnonzero(fresh | (start > before))
        gap = begins[~fresh[begins]]
        parts = []
        if len(gap):
            parts.append(pdf.iloc[gap][ids].assign(kind="gap", from_ms=before[gap], to_ms=start[gap]))
        closes = begins if state else begins[1:]
        if len(closes):
            opened = np.concatenate(([state.start] if state else [], start[begins])).astype(np.int64)[: len(closes)]
            inner = closes[closes > 0]
            own = pdf.iloc[inner - 1][ids].assign(kind="period", from_ms=opened[len(closes) - len(inner) :], to_ms=top[inner - 1])
            parts.append(own)
            if len(inner) < len(closes):
                parts.append(_row(state, ids))
        begun = start[begins[-1]] if len(begins) else state.start
        state = Open(key[-1], int(begun), int(top[-1]), tuple(None if pd.isna(x) else x for x in pdf.iloc[-1][ids]))
        yield (pd.concat(parts, ignore_index=True) if parts else None), state


def _row(island: Open, ids: list[str]) -> pd.DataFrame:
    return pd.DataFrame([dict(zip(ids, island.ident)) | {"kind": "period", "from_ms": island.start, "to_ms": island.end}])


def combine(summaries: dict[int, Summary]) -> tuple[dict[int, Open], set[int]]:
    """The island carried into each partition, and the partitions whose last island ends with them."""
    carried: dict[int, Open] = {}
    closing: set[int] = set()
    state: Open | None = None
    previous = -1
    for at in sorted(summaries):
        s = summaries[at]
        if state is not None:
            if state.key == s.first_key and s.first_start <= state.end:
                carried[at] = state
            elif state.key == s.first_key:
                carried[at] = state
            else:
                closing.add(previous)
        joined = state is not None and state.key == s.first_key == s.last.key
        if joined:
            begun = state.start if s.last.start <= state.end else s.last.start
            state = replace(s.last, start=begun, end=max(state.end, s.last.end))
        else:
            state = s.last
        previous = at
    if state is not None:
        closing.add(previous)
    return carried, closing


def periods_and_gaps(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Periods and gaps of the intervals [start, end) of each entity.

    df: integer columns start and end; others are ignored. by: the entity's columns; nulls are an
    entity of their own. Rows with a null bound or end <= start are left out. Repeated intervals
    count once; touching intervals form one period. Columns: by, kind (period or gap), from_ms,
    to_ms. An empty table gives no rows.
    """
    ids = list(by)
    key = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ids])
    rows = (
        df.where(F.col(end) > F.col(start))
        .groupBy(*ids, F.col(start).cast("long").alias("__start"))
        .agg(F.max(F.col(end).cast("long")).alias("__end"))
        .withColumn("__key", key)
        .withColumns({c: F.col(c).cast("string") for c in ids})  # a nullable integer would reach pandas as a float
    )
    ordered = cut(
        rows.repartitionByRange("__key", "__start")
        .sortWithinPartitions("__key", "__start")
        .withColumn("__part", F.spark_partition_id())
    )
    found = {r["part"]: Summary(r["first_key"], r["first_start"], Open(r["last_key"], r["begun"], r["top"], tuple(r[c] for c in ids))) for r in ordered.mapInPandas(_summarise(ids), _summary_schema(ordered, ids)).collect()}
    carried, closing = combine(found)
    fields = [ordered.schema[c] for c in ids]
    schema = T.StructType([*fields, T.StructField("kind", T.StringType()), T.StructField("from_ms", T.LongType()), T.StructField("to_ms", T.LongType())])
    return ordered.mapInPandas(_rescan(ids, carried, closing), schema).withColumns({c: F.col(c).cast(df.schema[c].dataType) for c in ids})


def _summary_schema(df: DataFrame, ids: list[str]) -> T.StructType:
    return T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("first_key", T.StringType()), T.StructField("first_start", T.LongType()),
        T.StructField("last_key", T.StringType()), T.StructField("begun", T.LongType()), T.StructField("top", T.LongType()), *[df.schema[c] for c in ids],
    ])


def _summarise(ids: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: list = []

        def noted() -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf) and not first:
                    first.extend([int(pdf["__part"].iloc[0]), pdf["__key"].iloc[0], int(pdf["__start"].iloc[0])])
                yield pdf

        state = None
        for _, state in _scan(noted(), None, ids):
            pass
        if state:
            yield pd.DataFrame([{"part": first[0], "first_key": first[1], "first_start": first[2], "last_key": state.key, "begun": state.start, "top": state.end} | dict(zip(ids, state.ident))])

    return run


def _rescan(ids: list[str], carried: dict[int, Open], closing: set[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    columns = [*ids, "kind", "from_ms", "to_ms"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = next((b for b in batches if len(b)), None)
        if head is None:
            return
        part = int(head["__part"].iloc[0])

        def all_of() -> Iterator[pd.DataFrame]:
            yield head
            yield from batches

        state = None
        for out, state in _scan(all_of(), carried.get(part), ids):
            if out is not None:
                yield out[columns]
        if part in closing and state:
            yield _row(state, ids)[columns]

    return run
