"""Queries on per-frame metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.operators import metrics as M
from murmuro.session import table


def _rows(spark: SparkSession, base: str) -> DataFrame:
    """The metrics with their model's frame rate and number of codebooks (layouts: a row per model)."""
    return table(spark, base, "model_metrics").join(table(spark, base, "layouts").select("model", "frame_rate", "num_codebooks"), "model")


def _cells(spark: SparkSession, base: str) -> DataFrame:
    """The last computation of every sequence as sums per codebook, with its model's frame rate."""
    return M.latest_cells(table(spark, base, "model_metrics")).join(table(spark, base, "layouts").select("model", "frame_rate"), "model")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def nll_summary(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(M.nll_summary(_cells(spark, base), ["model"], F.col("frame_rate")), "avg_nll", "kbps")


def nll_breakdown_share(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(M.nll_breakdown(_cells(spark, base), ["model"], F.col("frame_rate")), "avg_nll", "kbps", "share_pct")


def codebook_mean_entropy_bits(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(M.codebook_entropy(_cells(spark, base), ["model"]), "entropy_bits")


def _halves(spark: SparkSession, base: str) -> DataFrame:
    return M.group_entropy(_rows(spark, base), ["model", "row_id", "seq_id", "frame_idx", "frame_rate"], F.col("num_codebooks"), latest=True)


def entropy_halves(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(_halves(spark, base), "semantic", "audio_half_1", "audio_half_2").drop("frame_rate")


def group_frame_records(spark: SparkSession, base: str) -> DataFrame:
    """The groups of each frame as rows over time in seconds."""
    return _rounded(M.group_frame_records(_halves(spark, base), ["model", "row_id", "seq_id"], "frame_idx", F.col("frame_rate")), "x", "entropy_bits")


def row_metrics(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(M.row_metrics(_cells(spark, base)), "entropy_bits", "nll_bits")


def frame_offsets(spark: SparkSession, base: str) -> DataFrame:
    return M.frame_offsets(_rows(spark, base), latest=True)


def available_rows(spark: SparkSession, base: str) -> DataFrame:
    return M.available_rows(table(spark, base, "model_metrics"))


def row_pooled_summary(spark: SparkSession, base: str) -> DataFrame:
    """The summary of the first ten rows of each model, frames pooled."""
    rows = _cells(spark, base)
    return _rounded(M.nll_summary(rows.join(M.available_rows(rows, 10), ["model", "row_id"], "left_semi"), ["model"], F.col("frame_rate")), "avg_nll", "kbps")


def models_discovery(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "model_metrics").select("model").distinct()


def quality_gate_chance(spark: SparkSession, base: str) -> DataFrame:
    """Against the chance level of 2051 codes."""
    return _rounded(M.quality_gate(_cells(spark, base), F.lit(2051.0)), "avg_nll", "chance", "excess")


def residual_eval(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(M.residual_eval(_cells(spark, base), F.col("frame_rate")), "avg_nll", "kbps", "worst_nll")


def summary_table(spark: SparkSession, base: str) -> DataFrame:
    """The cells of the summary table, as they are printed."""
    s = M.nll_summary(_cells(spark, base), ["model"], F.col("frame_rate"))

    def of(scope: str, column: str) -> Column:
        return F.max(F.when(F.col("scope") == scope, F.col(column)))

    out = s.groupBy("model").agg(of("total", "num_codebooks").cast("string").alias("codebooks"), of("semantic", "avg_nll").alias("a"), of("audio", "avg_nll").alias("b"), of("semantic", "kbps").alias("c"), of("audio", "kbps").alias("d"), of("total", "kbps").alias("e"))
    text = {"semantic_nll": ("a", 2), "audio_nll": ("b", 2), "semantic_kbps": ("c", 3), "audio_kbps": ("d", 3), "total_kbps": ("e", 3)}
    return out.select("model", "codebooks", *[F.format_string(f"%.{n}f", F.round(c, n)).alias(name) for name, (c, n) in text.items()])


QUERIES = {f.__name__: f for f in (
    nll_summary, nll_breakdown_share, codebook_mean_entropy_bits, entropy_halves, group_frame_records, row_metrics, frame_offsets, available_rows, row_pooled_summary, models_discovery,
    quality_gate_chance, residual_eval, summary_table,
)}

_M = """
  l AS (SELECT m.*, frame_rate, num_codebooks FROM model_metrics m JOIN (SELECT model, row_id, seq_id, max(computed_at) AS t FROM model_metrics GROUP BY ALL) r
        ON m.model = r.model AND m.row_id IS NOT DISTINCT FROM r.row_id AND m.seq_id IS NOT DISTINCT FROM r.seq_id AND m.computed_at IS NOT DISTINCT FROM r.t JOIN layouts y ON y.model = m.model),
  v AS (SELECT * REPLACE (CASE WHEN isfinite(entropy) THEN CAST(entropy AS DOUBLE) END AS entropy, CASE WHEN isfinite(nll) THEN CAST(nll AS DOUBLE) END AS nll) FROM l)
"""
_SUM = """
  c AS (SELECT model, CASE WHEN codebook = 0 THEN 'semantic' ELSE 'audio' END AS scope, codebook, sum(nll) AS s, count(nll) AS n, max(frame_rate) AS r FROM {v} WHERE codebook IS NOT NULL GROUP BY ALL),
  t AS (SELECT * FROM c UNION ALL SELECT * REPLACE ('total' AS scope) FROM c),
  q AS (SELECT model, scope, count(*) AS num_codebooks, sum(s) / sum(n) AS avg_nll, sum(s) / sum(n) / ln(2) * max(r) * count(*) / 1000 AS kbps FROM t GROUP BY ALL)
"""
_GROUPS = """
  g AS (SELECT model, row_id, seq_id, frame_idx, max(frame_rate) AS r, avg(entropy) FILTER (codebook = 0) / ln(2) AS semantic, avg(entropy) FILTER (codebook BETWEEN 1 AND num_codebooks // 2) / ln(2) AS audio_half_1,
               avg(entropy) FILTER (codebook > num_codebooks // 2) / ln(2) AS audio_half_2 FROM v GROUP BY ALL)
"""
_GROUPS = _GROUPS.replace("GROUP BY ALL", "GROUP BY model, row_id, seq_id, frame_idx")
SQL = {
    "nll_summary": f"WITH {_M}, {_SUM.format(v='v')} SELECT model, scope, num_codebooks, round(avg_nll, 6) AS avg_nll, round(kbps, 6) AS kbps FROM q",
    "nll_breakdown_share": f"""WITH {_M}, {_SUM.format(v='v')}, b AS (SELECT model, scope, 1 AS num_codebooks, s / n AS avg_nll, s / n / ln(2) * r / 1000 AS kbps, lpad(CAST(codebook AS VARCHAR), 2, '0') AS codebook FROM c),
        u AS (SELECT *, '-' AS codebook FROM q UNION ALL BY NAME SELECT * FROM b)
        SELECT model, scope, num_codebooks, round(avg_nll, 6) AS avg_nll, round(kbps, 6) AS kbps, codebook, round(100 * kbps / max(kbps) FILTER (scope = 'total') OVER (PARTITION BY model), 6) AS share_pct FROM u""",
    "codebook_mean_entropy_bits": f"WITH {_M} SELECT model, codebook, round(avg(entropy) / ln(2), 6) AS entropy_bits FROM v GROUP BY ALL",
    "entropy_halves": f"WITH {_M}, {_GROUPS} SELECT model, row_id, seq_id, frame_idx, round(semantic, 6) AS semantic, round(audio_half_1, 6) AS audio_half_1, round(audio_half_2, 6) AS audio_half_2 FROM g",
    "group_frame_records": f"""WITH {_M}, {_GROUPS} SELECT model, row_id, seq_id, round(frame_idx / r, 6) AS x, unnest(['semantic', 'audio_half_1', 'audio_half_2']) AS scope,
        round(unnest([semantic, audio_half_1, audio_half_2]), 6) AS entropy_bits FROM g""",
    "row_metrics": f"WITH {_M} SELECT model, row_id, codebook, round(avg(entropy) / ln(2), 6) AS entropy_bits, round(avg(nll) / ln(2), 6) AS nll_bits FROM v GROUP BY ALL",
    "frame_offsets": f"""WITH {_M}, n AS (SELECT model, row_id, seq_id, count(DISTINCT frame_idx) AS n_frames FROM v GROUP BY ALL)
        SELECT *, CAST(sum(n_frames) OVER (PARTITION BY model, row_id ORDER BY seq_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - n_frames AS frame_offset FROM n""",
    "available_rows": "SELECT DISTINCT model, row_id FROM model_metrics",
    "row_pooled_summary": f"""WITH {_M}, k AS (SELECT model, row_id, row_number() OVER (PARTITION BY model ORDER BY row_id) AS k FROM (SELECT DISTINCT model, row_id FROM v)),
        w AS (SELECT v.* FROM v JOIN k ON v.model = k.model AND v.row_id = k.row_id AND k.k <= 10), {_SUM.format(v='w')} SELECT model, scope, num_codebooks, round(avg_nll, 6) AS avg_nll, round(kbps, 6) AS kbps FROM q""",
    "models_discovery": "SELECT DISTINCT model FROM model_metrics",
    "quality_gate_chance": f"""WITH {_M} SELECT model, codebook, round(avg(nll), 6) AS avg_nll, round(ln(2051), 6) AS chance, avg(nll) < 0.9 * ln(2051) AS passes,
        round(avg(nll) FILTER (entropy IS NOT NULL) - avg(entropy) FILTER (nll IS NOT NULL), 6) AS excess FROM v GROUP BY ALL""",
    "residual_eval": f"""WITH {_M}, b AS (SELECT model, codebook, sum(nll) / count(nll) AS a, count(nll) AS n, max(frame_rate) AS r FROM v WHERE codebook >= 1 GROUP BY ALL)
        SELECT model, max(n) AS n_frames, round(avg(a), 6) AS avg_nll, round(avg(a) / ln(2) * max(r) * count(*) / 1000, 6) AS kbps, arg_max(codebook, (a, -codebook)) AS worst_codebook, round(max(a), 6) AS worst_nll FROM b GROUP BY model""",
    "summary_table": f"""WITH {_M}, {_SUM.format(v='v')} SELECT model, CAST(max(num_codebooks) FILTER (scope = 'total') AS VARCHAR) AS codebooks,
        format('{{:.2f}}', round(max(avg_nll) FILTER (scope = 'semantic'), 2)) AS semantic_nll, format('{{:.2f}}', round(max(avg_nll) FILTER (scope = 'audio'), 2)) AS audio_nll,
        format('{{:.3f}}', round(max(kbps) FILTER (scope = 'semantic'), 3)) AS semantic_kbps, format('{{:.3f}}', round(max(kbps) FILTER (scope = 'audio'), 3)) AS audio_kbps,
        format('{{:.3f}}', round(max(kbps) FILTER (scope = 'total'), 3)) AS total_kbps FROM q GROUP BY model""",
}
