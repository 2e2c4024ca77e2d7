"""Readers of rows, transcripts, prompts and scripts, and the selection of rows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.sources import files

SEGMENT = "array<struct<segment_id: int, start: double, end: double, channel: int, speaker: string, text: string>>"
TRANSCRIPT = f"dataset string, split string, row bigint, sample_rate int, num_channels int, duration_sec double, segments {SEGMENT}"


def select_rows(df: DataFrame, rows: Sequence[int], column: str = "row") -> DataFrame:
    """The rows with the given numbers; the filter reaches the Parquet scan. Raises on none and on negative numbers."""
    if not rows or min(rows) < 0:
        raise ValueError("row numbers must be given and not be negative")
    return df.where((F.col(column) <= max(rows)) & F.col(column).isin(*rows))


def selected(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose number is in a table of any size."""
    return df.join(wanted.select(column).distinct(), column, "left_semi")


def missing(wanted: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """The wanted numbers that df doesn't have."""
    return wanted.select(column).distinct().join(df.select(column), column, "left_anti")


def row_count(df: DataFrame) -> int:
    """Counted from file footers where the source can. Raises on an empty table."""
    n = df.count()
    if not n:
        raise ValueError("no rows")
    return n


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript files, one JSON object each, as one row per segment; missing speakers are 'speaker'."""
    rows = spark.read.schema(TRANSCRIPT).json(path, multiLine=True)
    flat = rows.select("dataset", "split", F.col("row").alias("source_dataset_id"), "sample_rate", "num_channels", "duration_sec", F.explode("segments").alias("s"))
    return flat.select(
        "dataset", "split", "source_dataset_id", "sample_rate", "num_channels", "duration_sec", F.coalesce("s.channel", F.lit(0)).alias("source_audio_channel_id"),
        F.col("s.segment_id").alias("segment_id"), F.col("s.text").alias("text"), F.coalesce("s.speaker", F.lit("speaker")).alias("speaker"), F.col("s.start").alias("start_sec"), F.col("s.end").alias("end_sec"),
    )


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """The field text of each line of JSON; blank lines count for nothing."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.get_json_object("value", "$.text").alias("text"))


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """turn, speaker (0 or 1, 0 if none), text of a script in YAML. Raises on other speakers and on empty texts."""
    import yaml

    items = yaml.safe_load(files.read(path).decode())["segments"]
    rows = [(i, int(x.get("speaker", 0)), str(x["text"]).strip()) for i, x in enumerate(items)]
    if not rows or any(s not in (0, 1) or not t for _, s, t in rows):
        raise ValueError("a script needs turns with text by speaker 0 or 1")
    return spark.createDataFrame(rows, "turn int, speaker int, text string")


def last_checkpoint(spark: SparkSession, pattern: str) -> str:
    """The last, by name, of the paths that match."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    names = sorted(f.getPath().toUri().getPath() for f in found or [])
    if not names:
        raise FileNotFoundError(pattern)
    return names[-1]


def expected_frames(info: str, split: str) -> F.Column:
    """total_{split}_frames of a JSON text; null where it is missing or no JSON."""
    return F.try_to_number(F.get_json_object(F.col(info), f"$.total_{split}_frames"), F.lit("9999999999999")).cast("long")


def write_codebooks(codes: DataFrame, path: str) -> None:
    """Writes codec frames (row, channel, codes ARRAY<ARRAY<INT>>, sample_rate, frame_rate) with num_codebooks, read off each row's frames. Raises, in the task, where frames of a row differ in width."""
    width = F.size(F.get("codes", F.lit(0)))
    uneven = F.exists("codes", lambda c: F.size(c) != width)
    checked = F.when(uneven, F.raise_error(F.lit("frames of a channel differ in their number of codes")).cast("int")).otherwise(width)
    codes.withColumn("num_codebooks", checked).write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, summary: DataFrame, path: str) -> None:
    """Writes per-frame metrics as Parquet by model (path/frames) and their summary, a few rows a model and row, as JSON (path/summary)."""
    metrics.write.mode("overwrite").partitionBy("model").parquet(f"{path}/frames")
    summary.write.mode("overwrite").json(f"{path}/summary")


def read_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The frames and the summary that write_metrics wrote."""
    return spark.read.parquet(f"{path}/frames"), spark.read.json(f"{path}/summary")


def write_report(df: DataFrame, path: str) -> None:
    """Writes a report of one row, such as an evaluation's, as one JSON file. Raises unless it is one row."""
    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a report is one row")
    with files.written(path) as f:
        f.write((json.dumps(json.loads(rows[0]), indent=2) + "\n").encode())


def write_features(df: DataFrame, path: str, layout: Sequence[str], cache: str = "kv_cache") -> bool:
    """Writes featurized sequences, and their caches (keys, kv_cache) beside them where any sequence has one; gives whether. See write_sequences for what raises."""
    keys = [c for c in ("dataset", "model", "row_id", "seq_id") if c in df.columns]
    has = cache in df.columns and bool(df.where(F.col(cache).isNotNull()).limit(1).count())
    write_sequences(df.drop(cache), f"{path}/features", layout)
    caches = f"{path}/caches"
    if has:
        df.where(F.col(cache).isNotNull()).select(*keys, cache).write.mode("overwrite").parquet(caches)
    else:  # an earlier run's would be taken for this one's
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(caches)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    return has


def write_failures(df: DataFrame, path: str) -> None:
    """Appends quarantined rows as lines of JSON."""
    df.write.mode("append").json(path)


def write_sequences(df: DataFrame, path: str, layout: Sequence[str]) -> None:
    """Writes sequences by dataset and model. Raises on none and on rows of one model that differ in layout."""
    counts = df.groupBy("model").agg(F.countDistinct(*layout).alias("n")).collect()
    if not counts or any(r["n"] > 1 for r in counts):
        raise ValueError("sequences of a model must exist and share one layout")
    df.write.mode("overwrite").partitionBy(*[c for c in ("dataset", "model") if c in df.columns]).parquet(path)


def load_sequences(spark: SparkSession, path: str, caches: str | None = None, keys: Sequence[str] = ("model", "row_id", "seq_id")) -> DataFrame:
    """Stored sequences; with caches their stored caches too, null where a sequence has none."""
    rows = spark.read.parquet(path)
    return rows if caches is None else rows.join(spark.read.parquet(caches), list(keys), "left")


def unmatched(tokenized: DataFrame, featurized: DataFrame, keys: Sequence[str] = ("model", "row_id", "seq_id")) -> DataFrame:
    """Sequences that only one side has: keys, side (tokenized or featurized)."""
    t, f = tokenized.select(*keys).distinct().withColumn("t", F.lit(1)), featurized.select(*keys).distinct().withColumn("f", F.lit(1))
    return t.join(f, list(keys), "full").where("t is null or f is null").select(*keys, F.when(F.col("t").isNotNull(), "tokenized").otherwise("featurized").alias("side"))


def split_valid(df: DataFrame, reason: F.Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose reason is 'ok', and the others with their reason, for write_failures."""
    marked = df.withColumn("reason", F.coalesce(reason, F.lit("unknown")))
    return marked.where("reason = 'ok'").drop("reason"), marked.where("reason <> 'ok'")


def resampled(df: DataFrame, share: float, seed: int) -> DataFrame:
    """Rows drawn with replacement, share of them per pass on average."""
    return df.sample(withReplacement=True, fraction=share, seed=seed)


def read_warmup(spark: SparkSession, manifest: str, clips: DataFrame) -> DataFrame:
    """Clips of a manifest in YAML (speaker, audio, text) joined with read_wav's rows by file name: turn, speaker, text, sample_rate, samples. Raises if a clip is missing."""
    import yaml

    items = yaml.safe_load(files.read(manifest).decode())["segments"]
    listed = spark.createDataFrame([(i, int(x["speaker"]), str(x["text"]), str(x["audio"]).rsplit("/", 1)[-1]) for i, x in enumerate(items)], "turn int, speaker int, text string, file string")
    named = clips.where("channel = 0").withColumn("file", F.substring_index("path", "/", -1)).select("file", "sample_rate", "samples")
    gone = listed.join(named, "file", "left_anti").select("file").collect()
    if gone:
        raise FileNotFoundError(", ".join(r["file"] for r in gone))
    return listed.join(named, "file").select("turn", "speaker", "text", "sample_rate", "samples")
