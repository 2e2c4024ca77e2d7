"""Queries on training shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.functions.scalars import sample_key
from murmuro.operators import shards as H
from murmuro.operators.compaction import record_manifest, shard_records
from murmuro.session import store, table

#: Shuffle, share of train and samples in a shard.
SEED, RATIO, PER_SHARD, BATCH = 42, 0.95, 250, 2048


def _records(spark: SparkSession, base: str) -> DataFrame:
    """Each record once with frames (0 where not known) and its key in text."""
    m = record_manifest(table(spark, base, "shard_meta")).withColumn("frames", F.greatest(F.coalesce("audio_frames", F.lit(0)), F.lit(0)).cast("long"))
    return m.withColumn("id", F.concat_ws("/", "model", sample_key(F.col("row_id"), F.col("seq_id"))))


def sample_keys(spark: SparkSession, base: str) -> DataFrame:
    out = H.samples(_records(spark, base).drop("audio_frames").withColumnRenamed("frames", "audio_frames"))
    return out.select("model", "key", F.get_json_object("meta", "$.row_id").cast("long").alias("meta_row"), F.get_json_object("meta", "$.audio_frames").cast("long").alias("meta_frames"))


def _split(spark: SparkSession, base: str) -> DataFrame:
    return H.shuffle_split(store(_records(spark, base).select("id", "frames"), "records"), F.col("id"), SEED, RATIO, PER_SHARD)


def shuffle_split(spark: SparkSession, base: str) -> DataFrame:
    return _split(spark, base).select("id", "place", "split", "shard")


def shard_index(spark: SparkSession, base: str) -> DataFrame:
    return H.shard_index(_split(spark, base), "frames")


def dataset_info(spark: SparkSession, base: str) -> DataFrame:
    return H.dataset_info(_split(spark, base), "frames")


def _batches(spark: SparkSession, base: str, drop_last: bool) -> DataFrame:
    return H.frame_batches(_records(spark, base).select("model", "row_id", "seq_id", "frames"), ["model"], None, ["row_id", "seq_id"], "frames", BATCH, drop_last)


def frame_batches(spark: SparkSession, base: str) -> DataFrame:
    return _batches(spark, base, False)


def frame_batches_drop_last(spark: SparkSession, base: str) -> DataFrame:
    return _batches(spark, base, True)


def failure_records(spark: SparkSession, base: str) -> DataFrame:
    """Stored samples that can't be used, by reason and model."""
    rows = shard_records(table(spark, base, "shard_meta"))
    reason = F.when(F.col("audio_frames").isNull(), "no frames").when(F.col("audio_frames") <= 0, "empty").when(F.col("frame_rate").isNull(), "no rate")
    return rows.withColumn("reason", reason).where("reason is not null").groupBy("model", "reason").agg(F.count(F.lit(1)).alias("n"))


def info_frames(spark: SparkSession, base: str) -> DataFrame:
    """total_train_frames of descriptions in JSON, null where it isn't there or no number."""
    from murmuro.sources.tables import expected_frames

    info = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"total_train_frames": '), F.col("user_id").cast("string"), F.lit("}"))).when(F.col("event_id") % 3 == 1, "{}").otherwise("no json")
    rows = table(spark, base, "events").select("event_id", info.alias("info"))
    return rows.select("event_id", F.coalesce(expected_frames("info", "train"), F.lit(-1)).alias("frames"))


QUERIES = {f.__name__: f for f in (sample_keys, shuffle_split, shard_index, dataset_info, frame_batches, frame_batches_drop_last, failure_records, info_frames)}

_R = r"""
  a AS (SELECT coalesce(nullif(lower(trim(model)), ''), lower(split_part(shard_file, '/', 2))) AS model, coalesce(row_id, TRY_CAST(regexp_extract(sample_key, '(\d+)[_-](\d+)', 1) AS BIGINT)) AS row_id,
         coalesce(seq_id, TRY_CAST(regexp_extract(sample_key, '(\d+)[_-](\d+)', 2) AS INT)) AS seq_id, * EXCLUDE (model, row_id, seq_id) FROM shard_meta),
  r AS (SELECT *, greatest(coalesce(audio_frames, 0), 0) AS frames, model || '/' || printf('%08d_%05d', row_id, seq_id) AS id FROM a
        QUALIFY row_number() OVER (PARTITION BY model, row_id, seq_id ORDER BY written_at DESC, has_kv DESC, n_bytes DESC, audio_frames DESC NULLS LAST, shard_file DESC, sample_key DESC) = 1)
"""
_P = f"""WITH {_R}, p AS (SELECT id, frames, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS place, count(*) OVER () AS n FROM r),
  k AS (SELECT *, CASE WHEN place < floor(n * 0.95::DOUBLE) THEN 'train' ELSE 'val' END AS split,
        CAST(CASE WHEN place < floor(n * 0.95::DOUBLE) THEN place ELSE place - floor(n * 0.95::DOUBLE) END AS BIGINT) // 250 AS shard FROM p)"""
_F = f"""WITH {_R}, o AS (SELECT model, frames, CAST(sum(frames) OVER (PARTITION BY model ORDER BY row_id, seq_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM r),
  x AS (SELECT *, unnest(range((e - frames) // 2048, (e - 1) // 2048 + 1)) AS batch_no FROM o WHERE frames > 0)
  SELECT model, batch_no, CAST(sum(least(e, (batch_no + 1) * 2048) - greatest(e - frames, batch_no * 2048)) AS BIGINT) AS n_frames, count(*) AS n_items FROM x GROUP BY ALL"""
SQL = {
    "sample_keys": f"WITH {_R} SELECT model, printf('%08d_%05d', row_id, seq_id) AS key, row_id AS meta_row, CAST(frames AS BIGINT) AS meta_frames FROM r",
    "shuffle_split": f"{_P} SELECT id, place, split, shard FROM k",
    "shard_index": f"{_P} SELECT split, shard, count(*) AS num_samples, CAST(sum(frames) AS BIGINT) AS total_frames FROM k GROUP BY ALL",
    "dataset_info": f"{_P} SELECT split, count(*) AS num_samples, CAST(sum(frames) AS BIGINT) AS total_frames, count(DISTINCT shard) AS num_shards FROM k GROUP BY ALL",
    "frame_batches": _F,
    "frame_batches_drop_last": f"{_F} HAVING sum(least(e, (batch_no + 1) * 2048) - greatest(e - frames, batch_no * 2048)) = 2048",
    "failure_records": """SELECT coalesce(nullif(lower(trim(model)), ''), lower(split_part(shard_file, '/', 2))) AS model,
        CASE WHEN audio_frames IS NULL THEN 'no frames' WHEN audio_frames <= 0 THEN 'empty' WHEN frame_rate IS NULL THEN 'no rate' END AS reason, count(*) AS n FROM shard_meta
        WHERE audio_frames IS NULL OR audio_frames <= 0 OR frame_rate IS NULL GROUP BY ALL""",
    "info_frames": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id ELSE -1 END AS frames FROM events",
}
