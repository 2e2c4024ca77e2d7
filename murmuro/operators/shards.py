"""Shuffled, numbered and batched training shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuro.functions.scalars import sample_key
from murmuro.operators.ordered import running_sum, shuffled


def samples(records: DataFrame) -> DataFrame:
    """Adds key and meta (JSON) of each sample."""
    meta = F.to_json(F.struct(*[F.col(c) for c in ("row_id", "seq_id", "audio_frames", "model") if c in records.columns]))
    return records.withColumns({"key": sample_key(F.col("row_id"), F.col("seq_id")), "meta": meta})


def shuffle_split(df: DataFrame, key: Column, seed: int = 42, ratio: float = 0.95, per_shard: int = 250) -> DataFrame:
    """Adds place (in a shuffle by key), split (train below int(n * ratio)) and shard (place in the split div per_shard).

    The shuffle depends on the seed and the keys only, not on the order of rows.
    """
    placed = shuffled(df, key, seed, "place")
    n = df.count()
    train = int(n * ratio)
    inside = F.when(F.col("place") < train, F.col("place")).otherwise(F.col("place") - train)
    return placed.withColumns({"split": F.when(F.col("place") < train, "train").otherwise("val"), "shard": F.floor(inside / per_shard)})


def shard_index(placed: DataFrame, frames: str) -> DataFrame:
    return placed.groupBy("split", "shard").agg(F.count(F.lit(1)).alias("num_samples"), F.sum(frames).alias("total_frames"))


def dataset_info(placed: DataFrame, frames: str) -> DataFrame:
    return placed.groupBy("split").agg(F.count(F.lit(1)).alias("num_samples"), F.sum(frames).alias("total_frames"), F.countDistinct("shard").alias("num_shards"))


def frame_batches(items: DataFrame, by: list[str], bucket: Column | None, order: list, frames: str, batch: int, drop_last: bool = False) -> DataFrame:
    """Frames of all items one after another, cut into batches of a fixed number: by, batch_no, n_frames, n_items.

    An item may lie in several batches. drop_last leaves out a last batch that isn't full.
    """
    ends = running_sum(items, by, bucket, order, F.col(frames).cast("long"), "__end").withColumn("__start", F.col("__end") - F.col(frames)).where(F.col(frames) > 0)
    spread = ends.withColumn("batch_no", F.explode(F.sequence(F.floor(F.col("__start") / batch), F.floor((F.col("__end") - 1) / batch))))
    part = F.least("__end", (F.col("batch_no") + 1) * batch) - F.greatest("__start", F.col("batch_no") * batch)
    out = spread.groupBy(*by, "batch_no").agg(F.sum(part).alias("n_frames"), F.count(F.lit(1)).alias("n_items"))
    return out.where(F.col("n_frames") == batch) if drop_last else out
