"""Pieces of oversized recordings and records, cut at natural boundaries.

The boundaries form a tree: a recording has periods of speech, these have segments, and segments and records
have stretches between pauses, the longer the pause the higher. Sibling subtrees under one parent are merged
from left to right up to the limit; only a node that is itself over the limit is opened, and what it is cut
into isn't merged with its siblings, so no piece reaches over a higher boundary than it must. A stretch
without any boundary is cut into equal parts. Pieces after the first begin an overlap earlier, within the
limit.

What is very long is cut into sections of bounded length first, at the highest boundaries there are, so no
task holds all boundaries of a recording or record.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuro.llm.sequences import KEY, records, segments_once
from murmuro.operators.intervals import periods_and_gaps, to_ms
from murmuro.session import store

LIMIT_MS = 30_000
OVERLAP_MS = 1_000
#: Length of a section in limits.
SECTION_LIMITS = 64


def cut_tree(start: int, end: int, cuts: Sequence[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Pieces of [start, end), each at most limit long. cuts: (time, level), in order, 0 is the highest level."""
    if end - start <= limit:
        return [(start, end)]
    inner = [c for c in cuts if start < c[0] < end]
    if not inner:
        n = -(-(end - start) // limit)
        marks = [start + (end - start) * i // n for i in range(n + 1)]
        return list(zip(marks[:-1], marks[1:]))
    level = min(c[1] for c in inner)
    out: list[tuple[int, int]] = []
    whole = False  # whether the last piece consists of whole children
    lo, own = start, []
    for time, at in [*inner, (end, level)]:
        if at > level:
            own.append((time, at))
            continue
        if time - lo > limit:
            out += cut_tree(lo, time, own, limit)
            whole = False
        elif whole and time - out[-1][0] <= limit:
            out[-1] = (out[-1][0], time)
        else:
            out.append((lo, time))
            whole = True
        lo, own = time, []
    return out


def pieces_of(start: int, end: int, cuts: Sequence[tuple[int, int]], limit: int, overlap: int, first: bool = True) -> list[tuple[int, int]]:
    """Pieces that overlap; whole if it fits."""
    if first and end - start <= limit:
        return [(start, end)]
    found = cut_tree(start, end, cuts, limit - overlap)
    return [(max(0, a - overlap) if i or not first else a, b) for i, (a, b) in enumerate(found)]


def _cut(df: DataFrame, keys: list[str], limit: int, overlap: int) -> DataFrame:
    """df: keys, first, start, end, time, level; one row per boundary of a section, time null where there is none."""
    mark = F.when(F.col("time").isNotNull(), F.struct("time", "level"))
    grouped = df.groupBy(*keys).agg(F.max("first").alias("first"), F.max("start").alias("start"), F.max("end").alias("end"), F.collect_set(mark).alias("marks"))

    @F.pandas_udf("array<struct<start_ms: bigint, end_ms: bigint>>")
    def run(first: pd.Series, start: pd.Series, end: pd.Series, times: pd.Series, levels: pd.Series) -> pd.Series:
        out = []
        for one, a, b, ts, ls in zip(first, start, end, times, levels):
            marks: dict[int, int] = {}
            for t, level in zip(ts.tolist(), ls.tolist()):
                marks[t] = min(level, marks.get(t, level))
            out.append([{"start_ms": x, "end_ms": y} for x, y in pieces_of(int(a), int(b), sorted(marks.items()), limit, overlap, bool(one))])
        return pd.Series(out, dtype=object)

    pieces = run("first", "start", "end", F.transform("marks", lambda m: m["time"].cast("long")), F.transform("marks", lambda m: m["level"]))
    return grouped.select(*keys, F.posexplode(pieces).alias("piece_no", "p")).select(*keys, "piece_no", "p.start_ms", "p.end_ms")


def _sections(whole: DataFrame, marks: DataFrame, keys: list[str], limit: int, overlap: int) -> DataFrame:
    """Pieces (keys, section_no, piece_no, start_ms, end_ms) of what is longer than limit. whole: keys, last (its length); marks: keys, time, level, each once.

    Where it is longer than SECTION_LIMITS limits, a section ends in each stretch of that length, at the
    last of the highest boundaries there, else at the stretch's end.
    """
    length = limit * SECTION_LIMITS
    inside = store(marks.join(whole, keys).where("time > 0 and time < last").withColumn("stretch", F.floor(F.col("time") / length)).drop("last"), "marks")
    long = whole.where(F.col("last") > length)
    border = inside.join(long, keys, "left_semi").groupBy(*keys, "stretch").agg(F.max(F.struct((-F.col("level")).alias("l"), "time")).alias("b")).select(*keys, "stretch", F.col("b.time").alias("border"))
    stretches = long.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - 1) / length))))
    ends = F.when(F.col("stretch") == F.floor((F.col("last") - 1) / length), F.col("last")).otherwise(F.coalesce("border", (F.col("stretch") + 1) * length))
    before = Window.partitionBy(*keys).orderBy("stretch")  # a row per section
    ranges = stretches.join(border, [*keys, "stretch"], "left").withColumn("end", ends).select(*keys, F.col("stretch").alias("section_no"), F.coalesce(F.lag("end").over(before), F.lit(0)).alias("start"), "end").where("end > start")
    short = whole.where(F.col("last") <= length).select(*keys, F.lit(0).cast("long").alias("section_no"), F.lit(0).cast("long").alias("start"), F.col("last").alias("end"))
    ranges = store(ranges.unionByName(short), "sections")
    reached = F.array_distinct(F.array(F.floor(F.col("start") / length), F.floor((F.col("end") - 1) / length)))
    placed = ranges.select(*keys, "section_no", "start", "end", F.explode(reached).alias("stretch")).join(inside, [*keys, "stretch"]).where("time > start and time < end").select(*keys, "section_no", "time", "level")
    joined = ranges.join(placed, [*keys, "section_no"], "left").withColumn("first", (F.col("start") == 0) & (F.col("section_no") == 0))
    return _cut(joined.select(*keys, "section_no", "first", "start", "end", "time", "level"), [*keys, "section_no"], limit, overlap)


def record_pieces(meta: DataFrame, spans: DataFrame, layouts: DataFrame, segments: DataFrame, pauses: DataFrame, limit: int = LIMIT_MS, overlap: int = OVERLAP_MS) -> DataFrame:
    """(model, row_id, seq_id, piece_no, start_ms, end_ms) of each record longer than limit, from its own start.

    Cut in the middle of the pauses of its segment; pauses outside it, reversed or null ones don't count.
    """
    long = records(meta, spans, layouts).where(F.col("frames") / F.col("frame_rate") * 1000 > limit).withColumn("last", F.ceil(F.col("frames") / F.col("frame_rate") * 1000).cast("long"))
    long = store(long.select(*KEY, "source_dataset_id", "segment_id", "last"), "long")
    at = segments_once(segments).select("source_dataset_id", "segment_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    of = ["source_dataset_id", "segment_id"]
    silent = _pauses(pauses).join(long.select(*of).distinct(), of, "left_semi").join(at, of).where("p > s and p < e").groupBy(*of, (F.col("p") - F.col("s")).alias("time")).agg(F.min("level").alias("level"))
    marks = long.select(*KEY, *of).join(silent, of).select(*KEY, "time", "level")
    found = _sections(long.select(*KEY, "last"), marks, KEY, limit, overlap)
    earlier = Window.partitionBy(*KEY).orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)  # a row per section
    whole = store(found, "pieces")
    counts = whole.groupBy(*KEY, "section_no").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where("before > 0").drop("n")
    return whole.join(counts, [*KEY, "section_no"], "left").select(*KEY, (F.col("piece_no") + F.coalesce("before", F.lit(0))).cast("int").alias("piece_no"), "start_ms", "end_ms")


#: Pauses (ms) from which on they are the highest boundaries of a segment, and the next.
PAUSE_LEVELS = (1000, 400)


def _pauses(pauses: DataFrame) -> DataFrame:
    """source_dataset_id, segment_id, p (the middle of a pause) and level, by the pause's length."""
    a, b = to_ms(F.col("pause_start_sec")), to_ms(F.col("pause_end_sec"))
    level = F.when(b - a >= PAUSE_LEVELS[0], 0).when(b - a >= PAUSE_LEVELS[1], 1).otherwise(2)
    return pauses.where(b > a).groupBy("source_dataset_id", "segment_id", F.floor((a + b) / 2).alias("p")).agg(F.min(level).alias("level"))


def recording_pieces(segments: DataFrame, pauses: DataFrame, limit: int = LIMIT_MS, overlap: int = OVERLAP_MS) -> DataFrame:
    """(source_dataset_id, section_no, piece_no, start_ms, end_ms) of each recording whose last segment ends after limit.

    Boundaries are the ends of periods in which anyone speaks, of segments, and the middles of pauses.
    """
    once = store(segments_once(segments), "segments")
    whole = once.groupBy("source_dataset_id").agg(F.max("end_ms").alias("last")).where(F.col("last") > limit)
    periods = periods_and_gaps(once, ["source_dataset_id"], "start_ms", "end_ms").where("kind = 'period'").select("source_dataset_id", F.col("to_ms").alias("time"), F.lit(0).alias("level"))
    ends = once.select("source_dataset_id", F.col("end_ms").alias("time"), F.lit(1).alias("level"))
    at = once.select("source_dataset_id", "segment_id", "start_ms", "end_ms")
    silent = _pauses(pauses).join(at, ["source_dataset_id", "segment_id"]).where("p > start_ms and p < end_ms").select("source_dataset_id", F.col("p").alias("time"), (F.col("level") + 2).alias("level"))
    marks = periods.unionByName(ends).unionByName(silent).groupBy("source_dataset_id", "time").agg(F.min("level").alias("level"))
    return _sections(whole, marks, ["source_dataset_id"], limit, overlap)
