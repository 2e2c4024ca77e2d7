"""Queries on generation steps. An event is a step: value in ms, its type the component, its user the prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.functions import scalars as S
from murmuro.operators import dialogue as D
from murmuro.operators import timing as T
from murmuro.operators.models import loess
from murmuro.operators.ordered import numbered
from murmuro.session import table

RATE = 12.5


def _steps(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").where("value is not null")


def step_timing_stats(spark: SparkSession, base: str) -> DataFrame:
    v = F.col("value")
    out = T.step_stats(_steps(spark, base), ["event_type"], v, v * 0.4, v * 0.6, v * 0.1)
    return out.select("event_type", "n", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


def _generated(spark: SparkSession, base: str) -> DataFrame:
    return T.generations(_steps(spark, base), ["user_id"], F.col("value"), RATE)


def generation_speed(spark: SparkSession, base: str) -> DataFrame:
    """Elapsed over audio (rtf) and its reciprocal (speed_x) of each prompt."""
    g = _generated(spark, base)
    return g.select("user_id", "num_steps", *[F.round(c, 9).alias(c) for c in ("elapsed_s", "audio_s", "rtf", "speed_x", "tokens_per_s")])


def bench_aggregate_rtf(spark: SparkSession, base: str) -> DataFrame:
    return T.bench_aggregate(_generated(spark, base)).withColumn("mean_rtf", F.round("mean_rtf", 9))


def duration_format(spark: SparkSession, base: str) -> DataFrame:
    """Each prompt's audio as HH:MM:SS.mmm."""
    return _generated(spark, base).select("user_id", S.duration(F.col("audio_s") * 37).alias("text"))


def bench_metrics_json(spark: SparkSession, base: str) -> DataFrame:
    """The nested record of a report per component, as JSON."""
    v = F.col("value")
    s = T.step_stats(_steps(spark, base), ["event_type"], v, v * 0.4, v * 0.6, v * 0.1)
    record = F.to_json(F.struct(F.struct(F.round("gen_total", 6).alias("total"), F.round("gen_mean", 6).alias("per_step")).alias("generate_ms"), F.struct(F.round("decode_total", 6).alias("total")).alias("codec_decode_ms")))
    return s.select("event_type", F.get_json_object(record, "$.generate_ms.per_step").cast("double").alias("per_step"), F.get_json_object(record, "$.codec_decode_ms.total").cast("double").alias("decode_total"))


def _numbered(spark: SparkSession, base: str) -> DataFrame:
    return numbered(table(spark, base, "events"), ["user_id"], None, ["ts", "event_id"], "pos")


def stop_take_while(spark: SparkSession, base: str) -> DataFrame:
    """Steps of each prompt before its first error."""
    return D.take_while(_numbered(spark, base), ["user_id"], "pos", F.col("event_type") == "error").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last_pos"))


def emit_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Steps in chunks of two seconds of audio."""
    return D.chunks(_numbered(spark, base), ["user_id"], "pos", 2.0, RATE)


def token_budget(spark: SparkSession, base: str) -> DataFrame:
    """Frames allowed for each prompt's number of steps."""
    return _generated(spark, base).select("user_id", S.token_budget(F.col("num_steps"), 2000).alias("budget"))


def latency_budget(spark: SparkSession, base: str) -> DataFrame:
    """Steps that took longer than a frame lasts (80 ms), by component."""
    return _steps(spark, base).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 1000 / RATE).cast("long")).alias("n_late"))


def loess_trend(spark: SparkSession, base: str) -> DataFrame:
    """The trend of step times over the order of events, by component."""
    return loess(_steps(spark, base).select("event_type", F.col("event_id").cast("double").alias("at"), "value"), ["event_type"], "at", "value")


QUERIES = {f.__name__: f for f in (
    step_timing_stats, generation_speed, bench_aggregate_rtf, duration_format, bench_metrics_json, stop_take_while, emit_chunks, token_budget, latency_budget, loess_trend,
)}

_G = "g AS (SELECT user_id, count(value) AS num_steps, sum(value) / 1000 AS elapsed_s, count(value) / 12.5::DOUBLE AS audio_s FROM events WHERE value IS NOT NULL GROUP BY 1)"
_N = "n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"
SQL = {
    "step_timing_stats": """SELECT event_type, count(*) AS n, round(sum(value), 4) AS gen_total, round(avg(value), 4) AS gen_mean, round(avg(value * 0.4::DOUBLE), 4) AS backbone_mean, round(avg(value * 0.6::DOUBLE), 4) AS depth_mean,
        round(sum(value * 0.1::DOUBLE), 4) AS decode_total, round(sum(value * 0.1::DOUBLE) / count(*), 4) AS decode_mean, round(count(*) / (sum(value) / 1000), 4) AS rate FROM events WHERE value IS NOT NULL GROUP BY 1""",
    "generation_speed": f"""WITH {_G} SELECT user_id, num_steps, round(elapsed_s, 9) AS elapsed_s, round(audio_s, 9) AS audio_s, round(elapsed_s / audio_s, 9) AS rtf, round(audio_s / elapsed_s, 9) AS speed_x,
        round(num_steps / elapsed_s, 9) AS tokens_per_s FROM g""",
    "bench_aggregate_rtf": f"WITH {_G} SELECT count(*) AS num_prompts, CAST(sum(num_steps) AS BIGINT) AS num_steps, round(avg(elapsed_s / audio_s), 9) AS mean_rtf FROM g",
    "duration_format": f"""WITH {_G}, s AS (SELECT user_id, audio_s * 37 AS s FROM g)
        SELECT user_id, printf('%02d:%02d:%06.3f', CAST(floor(s) AS BIGINT) // 3600, CAST(floor(s) AS BIGINT) % 3600 // 60, s - floor(s / 60) * 60) AS text FROM s""",
    "bench_metrics_json": "SELECT event_type, round(avg(value), 6) AS per_step, round(sum(value * 0.1::DOUBLE), 6) AS decode_total FROM events WHERE value IS NOT NULL GROUP BY 1",
    "stop_take_while": f"""WITH {_N}, s AS (SELECT user_id, min(pos) AS stop FROM n WHERE event_type = 'error' GROUP BY 1)
        SELECT n.user_id, count(*) AS n, max(pos) AS last_pos FROM n LEFT JOIN s ON n.user_id = s.user_id WHERE stop IS NULL OR pos < stop GROUP BY 1""",
    "emit_chunks": f"WITH {_N} SELECT user_id, pos // 25 AS chunk_no, count(*) AS n_frames, count(*) < 25 AS is_final FROM n GROUP BY 1, 2",
    "token_budget": f"WITH {_G} SELECT user_id, least(2000, greatest(32, num_steps * 12)) AS budget FROM g",
    "latency_budget": "SELECT event_type, count(*) AS n, count(*) FILTER (value > 80) AS n_late FROM events WHERE value IS NOT NULL GROUP BY 1",
}
