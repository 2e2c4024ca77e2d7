"""Lengths of sequences and of recordings, as packing and splitting need them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuro.operators.compaction import shard_records
from murmuro.operators.intervals import valid_segments

KEY = ["model", "row_id", "seq_id"]


def audio_spans(spans: DataFrame) -> DataFrame:
    """(model, row_id, seq_id, audio, tokens): frames of the audio spans and of all spans; repeated rows count once."""
    size = F.greatest(F.col("span_end").cast("long") - F.col("span_start"), F.lit(0).cast("long"))
    audio = F.lower(F.trim("span_kind")) == "audio"
    once = spans.groupBy(F.lower(F.trim("model")).alias("model"), "row_id", "seq_id", "span_no").agg(F.max(size).alias("all"), F.max(F.when(audio, size)).alias("audio"))
    return once.groupBy(*KEY).agg(F.sum("audio").alias("audio"), F.sum("all").alias("tokens"))


def records(meta: DataFrame, spans: DataFrame, layouts: DataFrame) -> DataFrame:
    """Each record of shard_meta once: model, row_id, seq_id, source_dataset_id, segment_id, frames, frame_rate.

    frames is the last written audio_frames above 0, else the length of the audio spans; frame_rate is
    the last written one above 0, else that of the model's layout. Records whose length or rate isn't
    known either way are left out.
    """
    when = F.struct("written_at", "n_bytes", "audio_frames", "shard_file", "sample_key")
    frames, rate = F.col("audio_frames").cast("long"), F.col("frame_rate")
    once = shard_records(meta).groupBy(*KEY).agg(
        F.max_by("source_dataset_id", when).alias("source_dataset_id"), F.max_by("segment_id", when).alias("segment_id"),
        F.max(F.when(frames > 0, F.struct("written_at", frames.alias("v")))).alias("f"), F.max(F.when(rate > 0, F.struct("written_at", rate.alias("v")))).alias("r"),
    )
    known = layouts.groupBy(F.lower(F.trim("model")).alias("model")).agg(F.max("frame_rate").alias("layout_rate"))
    s = audio_spans(spans).select(*KEY, "audio")
    joined = once.join(s, KEY, "left").join(known, "model", "left")
    return joined.select(*KEY, "source_dataset_id", "segment_id", F.coalesce("f.v", "audio").alias("frames"), F.coalesce("r.v", "layout_rate").alias("frame_rate")).where("frames > 0 and frame_rate > 0")


def segments_once(segments: DataFrame) -> DataFrame:
    """The valid segments, each once: source_dataset_id, segment_id, start_ms, end_ms."""
    kept = valid_segments(segments).where("source_dataset_id is not null")
    return kept.groupBy("source_dataset_id", "segment_id").agg(F.min(F.struct("start_ms", "end_ms")).alias("r")).select("source_dataset_id", "segment_id", "r.start_ms", "r.end_ms")
