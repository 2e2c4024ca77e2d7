"""Segments of recordings: parsing, checks, frames, speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuro.functions.scalars import frame_end, frame_start
from murmuro.sources.tables import split_valid

# Where a transcript may stand in a row, in this order.
TRANSCRIPT_KEYS = ("json", "turns", "transcript", "segments")
ITEM = "array<struct<start_time_ms: double, end_time_ms: double, start: double, end: double, channel: int, speaker: string, text: string>>"


def parse_transcripts(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per transcript item: keep, segment_id (its place), channel, speaker, text, start_sec, end_sec, valid.

    The transcript is the first non-null column of TRANSCRIPT_KEYS: JSON text of a list of items, or of an
    object with the list under turns. Times are milliseconds if given so, else seconds; an absent and a
    null time are alike. Missing channel: 0, speaker: 'speaker', text: ''. valid: the end is after the
    start. Rows without a readable list have no item.
    """
    found = [F.col(k).cast("string") for k in TRANSCRIPT_KEYS if k in rows.columns]
    text = F.coalesce(*found)
    items = F.when(F.substring(F.ltrim(text), 1, 1) == "[", F.from_json(text, ITEM)).otherwise(F.from_json(F.get_json_object(text, "$.turns"), ITEM))
    flat = rows.select(*keep, F.posexplode(items).alias("segment_id", "i"))
    start = F.coalesce("i.start_time_ms", F.col("i.start") * 1000, F.lit(0.0))
    end = F.coalesce("i.end_time_ms", F.col("i.end") * 1000, F.lit(0.0))
    return flat.select(*keep, "segment_id", F.coalesce("i.channel", F.lit(0)).alias("channel"), F.coalesce("i.speaker", F.lit("speaker")).alias("speaker"), F.coalesce("i.text", F.lit("")).alias("text"), (start / 1000).alias("start_sec"), (end / 1000).alias("end_sec"), (end > start).alias("valid"))


def validity(channel: Column, channels: Column, start: Column, end: Column, duration: Column, rate: Column) -> Column:
    """Why a segment doesn't fit its recording; 'ok' if it does. A null bound of the recording checks nothing."""
    return (
        F.when(start.isNull() | end.isNull() | F.isnan(start) | F.isnan(end), "no time").when(end <= start, "reversed").when(channel >= channels, "channel").when(start < 0, "negative")
        .when(end > duration + 1 / rate, "late").otherwise("ok")
    )


def recordings_once(raw: DataFrame) -> DataFrame:
    """raw_rows with one row per recording: the last added."""
    when = F.struct("added_at", "duration_sec", "num_channels", "sample_rate")
    return raw.groupBy("row_id").agg(*[F.max_by(c, when).alias(c) for c in ("dataset", "split_name", "sample_rate", "num_channels", "duration_sec")])


def ingest(rows: DataFrame, row: str = "row") -> tuple[DataFrame, DataFrame]:
    """Rows of a data set (row, sample_rate, num_channels, duration_sec and a transcript) as segments, and what fails, with its reason.

    Failures are segments that don't fit their recording and rows without a readable transcript
    ('no transcript', segment_id null); write_failures keeps them.
    """
    about = ["sample_rate", "num_channels", "duration_sec"]
    items = parse_transcripts(rows, [row, *about]).drop("valid")
    good, bad = split_valid(items, validity(F.col("channel"), F.col("num_channels"), F.col("start_sec"), F.col("end_sec"), F.col("duration_sec"), F.col("sample_rate")))
    lost = rows.select(row).join(items.select(row).distinct(), row, "left_anti").select(row, F.lit(None).cast("int").alias("segment_id"), F.lit("no transcript").alias("reason"))
    return good, bad.select(row, "segment_id", "reason").unionByName(lost)


def check_segments(segments: DataFrame, raw: DataFrame) -> DataFrame:
    """segments with reason: 'no recording', or validity's."""
    r = recordings_once(raw).select(F.col("row_id").alias("__row"), F.col("num_channels").alias("__channels"), F.when(~F.isnan("duration_sec"), F.col("duration_sec")).alias("__duration"), F.col("sample_rate").alias("__rate"))
    joined = segments.join(r, segments["source_dataset_id"] == r["__row"], "left")
    reason = F.when(F.col("__row").isNull(), "no recording").otherwise(validity(F.col("source_audio_channel_id"), F.col("__channels"), F.col("start_sec"), F.col("end_sec"), F.col("__duration"), F.col("__rate")))
    return joined.withColumn("reason", reason).drop("__row", "__channels", "__duration", "__rate")


def frame_bounds(segments: DataFrame, frame_rate: Column, most: Column) -> DataFrame:
    """Adds frame_start and frame_end (half-open): the start rounded down, the end up, within [0, most). Segments without a frame are left out."""
    usable = segments.where("start_sec is not null and end_sec is not null and not isnan(start_sec) and not isnan(end_sec)")
    return usable.withColumns({"frame_start": frame_start(F.col("start_sec"), frame_rate), "frame_end": frame_end(F.col("end_sec"), frame_rate, most)}).where("frame_end > frame_start")


def slice_codes(bounds: DataFrame, codes: DataFrame, row: str, channel: str) -> DataFrame:
    """The frames of each segment's channel: codes (row, channel, codes ARRAY) joined and sliced to [frame_start, frame_end)."""
    joined = bounds.join(codes, [row, channel])
    return joined.withColumn("codes", F.slice("codes", F.col("frame_start").cast("int") + 1, (F.col("frame_end") - F.col("frame_start")).cast("int")))


def frames_of_segments(bounds: DataFrame, frames: DataFrame, by: list[str], frame: str, width: int = 256) -> DataFrame:
    """Interval join: every frame with the segments of its group that hold it.

    Both sides are dealt to bins of width frames (a segment to each bin it touches), so the join is an
    equi-join on (group, bin) and a long group is many bins.
    """
    s = bounds.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("frame_start") / width), F.floor((F.col("frame_end") - 1) / width))))
    f = frames.withColumn("__bin", F.floor(F.col(frame) / width))
    inside = (F.col(frame) >= F.col("frame_start")) & (F.col(frame) < F.col("frame_end"))
    return f.join(s, [*by, "__bin"]).where(inside).drop("__bin")


def covered_frames(bounds: DataFrame, by: list[str], width: int = 256) -> DataFrame:
    """Per group and bin of width frames: the segments that touch it and the frames they take there, counted once per segment."""
    bins = bounds.withColumn("bin", F.explode(F.sequence(F.floor(F.col("frame_start") / width), F.floor((F.col("frame_end") - 1) / width))))
    part = F.least("frame_end", (F.col("bin") + 1) * width) - F.greatest("frame_start", F.col("bin") * width)
    return bins.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n_segments"), F.sum(part).alias("n_frames"))


def speaker_numbers(segments: DataFrame) -> DataFrame:
    """Labels of a recording numbered from 0 by their first segment: source_dataset_id, speaker, speaker_no. A null label isn't one."""
    first = segments.where("speaker is not null").groupBy("source_dataset_id", "speaker").agg(F.min("segment_id").alias("__first"))
    w = Window.partitionBy("source_dataset_id").orderBy("__first", "speaker")
    return first.withColumn("speaker_no", F.row_number().over(w) - 1).drop("__first")
