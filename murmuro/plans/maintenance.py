"""Queries on stored files and on time intervals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.operators.compaction import compact_folder, compact_records, plan_shards, record_manifest
from murmuro.operators.intervals import periods_and_gaps, valid_segments
from murmuro.session import shared_dir, store, table

#: Bytes of a consolidated shard file.
SHARD_BYTES = 256 << 20


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    rows = compact_records(table(spark, base, "shard_meta"), SHARD_BYTES)
    return rows.where("n_copies > 1").select("model", "row_id", "seq_id")


def p6_shards(spark: SparkSession, base: str) -> DataFrame:
    """The new files: how many of the old ones, records and bytes each takes."""
    plan = plan_shards(store(record_manifest(table(spark, base, "shard_meta")), "manifest"), SHARD_BYTES)
    return plan.groupBy("bin").agg(F.countDistinct("shard_file").alias("n_files"), F.count(F.lit(1)).alias("n_records"), F.sum("n_bytes").alias("n_bytes"))


def p6_totals(spark: SparkSession, base: str) -> DataFrame:
    """Per model: records and bytes of the new set, and whether its files keep to their size and are less than half as many."""
    plan = plan_shards(store(record_manifest(table(spark, base, "shard_meta")), "manifest"), SHARD_BYTES)
    bins = plan.groupBy("model", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b"), F.countDistinct("shard_file").alias("f"))
    return bins.groupBy("model").agg(F.sum("n").alias("n_records"), F.sum("b").alias("n_bytes"), (F.max("b") <= SHARD_BYTES).alias("within"), (F.count(F.lit(1)) * 2 < F.sum("f")).alias("fewer"))


def p6_records(spark: SparkSession, base: str) -> DataFrame:
    """Each record of the new set, read back from its files."""
    return compact_records(table(spark, base, "shard_meta"), SHARD_BYTES).select("model", "row_id", "seq_id", "n_bytes", F.lit(1).alias("n"))


#: Folders of small files that p6_files makes, and bytes of a file it makes of them.
SMALL_FOLDERS, FOLDER_BYTES = 256, 4 << 20


def p6_files(spark: SparkSession, base: str) -> DataFrame:
    """All rows of shard_meta from a folder of small files (in folders whose names hold blanks and %), rewritten into few."""
    meta = table(spark, base, "shard_meta")
    folder = F.concat(F.lower(F.trim("model")), F.lit(" 100% /"), F.pmod(F.xxhash64("shard_file", "sample_key"), F.lit(SMALL_FOLDERS)).cast("string"))
    small, few = (f"{shared_dir(spark)}/{n}-{uuid.uuid4().hex}" for n in ("small files", "few files"))
    meta.withColumn("kept in", folder).repartition("kept in").write.partitionBy("kept in").parquet(small)
    return compact_folder(spark, small, few, FOLDER_BYTES).select("shard_file", "sample_key", "row_id", "seq_id", "model", "n_bytes", "audio_frames", "written_at", F.substring_index("kept in", " ", 1).alias("kept_in"))


def _intervals(spark: SparkSession, base: str) -> DataFrame:
    segments = valid_segments(table(spark, base, "segments"))
    return periods_and_gaps(segments, ["source_dataset_id", "source_audio_channel_id"], "start_ms", "end_ms")


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    gaps = _intervals(spark, base).where("kind = 'gap'")
    return gaps.select("source_dataset_id", "source_audio_channel_id", F.col("from_ms").alias("gap_start_ms"), F.col("to_ms").alias("gap_end_ms"))


def p7_periods(spark: SparkSession, base: str) -> DataFrame:
    periods = _intervals(spark, base).where("kind = 'period'")
    return periods.select("source_dataset_id", "source_audio_channel_id", F.col("from_ms").alias("start_ms"), F.col("to_ms").alias("end_ms"))


QUERIES = {"p6_found": p6_found, "p6_shards": p6_shards, "p6_totals": p6_totals, "p6_records": p6_records, "p6_files": p6_files, "p7_found": p7_found, "p7_periods": p7_periods}

_RECORDS = r"""
    SELECT coalesce(nullif(lower(trim(model)), ''), lower(split_part(shard_file, '/', 2))) AS model,
           coalesce(row_id, TRY_CAST(regexp_extract(sample_key, '(\d+)[_-](\d+)', 1) AS BIGINT)) AS row_id,
           coalesce(seq_id, TRY_CAST(regexp_extract(sample_key, '(\d+)[_-](\d+)', 2) AS INT)) AS seq_id,
           written_at, has_kv, n_bytes, audio_frames, shard_file
    FROM shard_meta
"""
_ISLANDS = """
    WITH v AS (
      SELECT source_dataset_id, source_audio_channel_id,
             CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS e
      FROM segments WHERE round(end_sec * 1000) > round(start_sec * 1000)
    ), m AS (
      SELECT *, max(e) OVER (PARTITION BY source_dataset_id, source_audio_channel_id ORDER BY s, e
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM v
    )
"""
SQL = {
    "p6_found": f"SELECT model, row_id, seq_id FROM ({_RECORDS}) GROUP BY ALL HAVING count(*) > 1",
    "p6_records": f"""
        SELECT model, row_id, seq_id, n_bytes, 1 AS n FROM (
          SELECT *, row_number() OVER (PARTITION BY model, row_id, seq_id
            ORDER BY written_at DESC NULLS LAST, has_kv DESC NULLS LAST, n_bytes DESC NULLS LAST, audio_frames DESC NULLS LAST, shard_file DESC) AS k
          FROM ({_RECORDS})) WHERE k = 1""",
    "p6_totals": f"""
        SELECT model, count(*) AS n_records, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, true AS within, true AS fewer FROM (
          SELECT * FROM ({_RECORDS}) QUALIFY row_number() OVER (PARTITION BY model, row_id, seq_id
            ORDER BY written_at DESC NULLS LAST, has_kv DESC NULLS LAST, n_bytes DESC NULLS LAST, audio_frames DESC NULLS LAST, shard_file DESC) = 1) GROUP BY model""",
    "p6_files": "SELECT shard_file, sample_key, row_id, seq_id, model, n_bytes, audio_frames, written_at, lower(trim(model)) AS kept_in FROM shard_meta",
    "p7_found": _ISLANDS + """
        SELECT source_dataset_id, source_audio_channel_id, top AS gap_start_ms, s AS gap_end_ms FROM m WHERE s > top""",
    "p7_periods": _ISLANDS + """
        , i AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END)
                  OVER (PARTITION BY source_dataset_id, source_audio_channel_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
        SELECT source_dataset_id, source_audio_channel_id, min(s) AS start_ms, max(e) AS end_ms FROM i
        GROUP BY source_dataset_id, source_audio_channel_id, island""",
}
