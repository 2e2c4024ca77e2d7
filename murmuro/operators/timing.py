"""Timings of generation steps and what is reported of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuro.functions.scalars import ratio


def step_stats(steps: DataFrame, by: Sequence[str], total_ms: Column, backbone_ms: Column, depth_ms: Column, decode_ms: Column) -> DataFrame:
    """Per group: n, gen_total, gen_mean, backbone_mean, depth_mean, decode_total, decode_mean (ms) and rate (steps a second); 0 where there is nothing to divide by."""
    n = F.count(total_ms)
    return steps.groupBy(*by).agg(
        n.alias("n"), F.coalesce(F.sum(total_ms), F.lit(0.0)).alias("gen_total"), F.coalesce(F.avg(total_ms), F.lit(0.0)).alias("gen_mean"), F.coalesce(F.avg(backbone_ms), F.lit(0.0)).alias("backbone_mean"),
        F.coalesce(F.avg(depth_ms), F.lit(0.0)).alias("depth_mean"), F.coalesce(F.sum(decode_ms), F.lit(0.0)).alias("decode_total"), ratio(F.coalesce(F.sum(decode_ms), F.lit(0.0)), n).alias("decode_mean"),
        ratio(n, F.sum(total_ms) / 1000).alias("rate"),
    )


def generations(steps: DataFrame, by: Sequence[str], total_ms: Column, frame_rate: float) -> DataFrame:
    """Per generation: num_steps, elapsed_s, audio_s (steps over the frame rate), rtf (elapsed over audio, lower is faster), speed_x (its reciprocal), tokens_per_s."""
    out = steps.groupBy(*by).agg(F.count(total_ms).alias("num_steps"), (F.coalesce(F.sum(total_ms), F.lit(0.0)) / 1000).alias("elapsed_s")).withColumn("audio_s", F.col("num_steps") / frame_rate)
    return out.withColumns({"rtf": ratio(F.col("elapsed_s"), F.col("audio_s")), "speed_x": ratio(F.col("audio_s"), F.col("elapsed_s")), "tokens_per_s": ratio(F.col("num_steps"), F.col("elapsed_s"))})


def bench_aggregate(generated: DataFrame) -> DataFrame:
    """Over all generations: their number, all steps, and the mean of their rtf, each generation counting the same."""
    return generated.agg(F.count(F.lit(1)).alias("num_prompts"), F.coalesce(F.sum("num_steps"), F.lit(0)).alias("num_steps"), F.coalesce(F.avg("rtf"), F.lit(0.0)).alias("mean_rtf"))
