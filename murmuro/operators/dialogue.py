"""Turns of a script: retries, stopping, stitching, chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuro.operators.ordered import running_sum


def pick_attempt(attempts: DataFrame, by: Sequence[str], order: Sequence[str], good: Column, keep: Sequence[str], most: int = 3) -> DataFrame:
    """Of the first so many attempts the first good one, else the last: by, keep, attempt_no (from 1), is_good."""
    first = Window.partitionBy(*by).orderBy(*order)
    tried = attempts.withColumn("attempt_no", F.row_number().over(first)).where(F.col("attempt_no") <= most).withColumn("is_good", F.coalesce(good, F.lit(False)))
    rank = F.struct((~F.col("is_good")).alias("bad"), F.when(F.col("is_good"), F.col("attempt_no")).otherwise(-F.col("attempt_no")).alias("at"))
    return tried.groupBy(*by).agg(F.min_by(F.struct(*keep, "attempt_no", "is_good"), rank).alias("t")).select(*by, "t.*")


def take_while(df: DataFrame, by: Sequence[str], position: str, stop: Column) -> DataFrame:
    """The rows of each group before its first stop."""
    ends = df.where(stop).groupBy(*by).agg(F.min(position).alias("__stop"))
    return df.join(ends, list(by), "left").where(F.col("__stop").isNull() | (F.col(position) < F.col("__stop"))).drop("__stop")


def stitch(turns: DataFrame, by: Sequence[str], bucket: Column | None, order: Sequence[str], length_ms: str, gap_ms: int) -> DataFrame:
    """Where each turn begins in the whole, with a gap between turns and none before the first: adds offset_ms."""
    placed = running_sum(turns, by, bucket, order, F.coalesce(F.col(length_ms), F.lit(0)) + gap_ms, "__end")
    return placed.withColumn("offset_ms", F.col("__end") - F.coalesce(F.col(length_ms), F.lit(0)) - gap_ms).drop("__end")


def chunks(df: DataFrame, by: Sequence[str], position: str, interval_s: float, frame_rate: float) -> DataFrame:
    """Frames in chunks as a stream emits them: by, chunk_no, n_frames, is_final (only the last, and only if it isn't full)."""
    size = max(1, int(interval_s * frame_rate))
    out = df.groupBy(*by, F.floor(F.col(position) / size).alias("chunk_no")).agg(F.count(F.lit(1)).alias("n_frames"))
    return out.withColumn("is_final", F.col("n_frames") < size)
