"""Per-frame entropy and negative log-likelihood, and what is summed up from them.

Metrics are long tables: one row per (model, row_id, seq_id, frame_idx, codebook). Averages pool
frames, so longer sequences weigh more; an average of averages is never taken. Values that are null, NaN
or infinite don't count, neither in sums nor in numbers of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuro.functions.logits import scores
from murmuro.functions.scalars import kbits_per_second, ratio
from murmuro.operators.ordered import running_sum


def finite(x: Column) -> Column:
    """x as DOUBLE, null unless finite."""
    wide = x.cast("double")
    return F.when(F.abs(wide) < float("inf"), wide)


def audio_frame_metrics(frames: DataFrame, logits: str, targets: str, nan_safe: bool = False, engine: str = "jvm") -> DataFrame:
    """Scores every codebook of every frame.

    frames: logits ARRAY<ARRAY<DOUBLE>>, one array per head, and targets ARRAY<INT> in the order of the
    heads, both dropped from the result. Adds codebook, entropy and nll. A null logits array gives no
    row; a null target, or one without a logit, a null nll. engine: "jvm" works with expressions,
    twice as fast as the other at 16 logits a head; "arrow" sends arrays to numpy, twice as fast from
    512 on (both measured).
    """
    keys = [c for c in frames.columns if c not in (logits, targets)]
    long = frames.select(*keys, targets, F.posexplode(logits).alias("codebook", "__logits"))
    target = F.get(targets, F.col("codebook"))
    scored = scores(F.col("__logits"), target, nan_safe) if engine == "jvm" else _numpy_scores(nan_safe)("__logits", target)
    return long.select(*keys, "codebook", scored.alias("__s")).select(*keys, "codebook", "__s.entropy", "__s.nll")


def _numpy_scores(nan_safe: bool):
    kind = T.StructType([T.StructField("entropy", T.DoubleType()), T.StructField("nll", T.DoubleType())])

    @F.arrow_udf(kind)
    def run(logits: pa.Array, targets: pa.Array) -> pa.Array:
        out, known = np.zeros((2, len(logits))), np.zeros((2, len(logits)), bool)
        wanted = targets.to_pylist()
        for i in range(len(logits)):
            row = logits[i]
            if not row.is_valid or not len(row):
                continue
            x = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = x.max()
            p = x - (top + np.log(np.exp(x - top).sum()))
            with np.errstate(invalid="ignore"):
                terms = np.exp(p) * p
            out[0, i], known[0, i] = -(np.nansum(terms) if nan_safe else terms.sum()), True
            if wanted[i] is not None and 0 <= wanted[i] < len(p):
                out[1, i], known[1, i] = -p[wanted[i]], True
        return pa.StructArray.from_arrays([pa.array(out[k], mask=~known[k]) for k in (0, 1)], ["entropy", "nll"])

    return run


def latest_runs(metrics: DataFrame) -> DataFrame:
    """The rows of each sequence's last computation; sequences are (model, row_id, seq_id)."""
    key = ["model", "row_id", "seq_id"]
    runs = metrics.groupBy(*key).agg(F.max("computed_at").alias("__last"))
    m, r = metrics.alias("m"), runs.alias("r")
    same = F.col("m.computed_at").eqNullSafe(F.col("r.__last"))
    for k in key:
        same = same & F.col(f"m.{k}").eqNullSafe(F.col(f"r.{k}"))
    return m.join(r, same, "left_semi").select("m.*")


SUMS = ("nll_sum", "nll_n", "entropy_sum", "entropy_n", "excess_sum", "excess_n")


def as_cells(metrics: DataFrame) -> DataFrame:
    """Rows with the sums that the summaries below add up; what has them already is left as it is."""
    if "nll_n" in metrics.columns:
        return metrics
    n, e = finite(F.col("nll")), finite(F.col("entropy"))
    excess = n - e
    sums = {f"{name}_sum": v for name, v in (("nll", n), ("entropy", e), ("excess", excess))} | {f"{name}_n": v.isNotNull().cast("long") for name, v in (("nll", n), ("entropy", e), ("excess", excess))}
    return metrics.withColumns(sums)


def latest_cells(metrics: DataFrame) -> DataFrame:
    """Sums per model, row_id, seq_id and codebook over each sequence's last computation.

    Rows are added up per computation before anything is shuffled; which one is the last is then seen on
    these few rows, so the metrics themselves are read once and never joined.
    """
    key = ["model", "row_id", "seq_id"]
    runs = as_cells(metrics).groupBy(*key, "computed_at", "codebook").agg(*[F.sum(c).alias(c) for c in SUMS])
    return _last_run(runs).drop("computed_at")


def _last_run(sums: DataFrame) -> DataFrame:
    """The rows of each sequence's last computation, of sums made per computation."""
    last = F.max("computed_at").over(Window.partitionBy("model", "row_id", "seq_id"))
    return sums.withColumn("__last", last).where(F.col("computed_at").eqNullSafe(F.col("__last"))).drop("__last")


def _mean(name: str) -> Column:
    return F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_n"))


def nll_summary(metrics: DataFrame, by: Sequence[str], frame_rate: Column) -> DataFrame:
    """Columns by, scope (semantic: codebook 0, audio: the others, total), num_codebooks, avg_nll, kbps.

    metrics: rows or cells. frame_rate is an expression that is constant within a group.
    """
    scope = F.when(F.col("codebook") == 0, "semantic").otherwise("audio")
    books = as_cells(metrics).where(F.col("codebook").isNotNull()).groupBy(*by, scope.alias("scope"), "codebook").agg(F.sum("nll_sum").alias("s"), F.sum("nll_n").alias("n"), F.max(frame_rate).alias("rate"))
    both = books.withColumn("scope", F.explode(F.array("scope", F.lit("total"))))
    out = both.groupBy(*by, "scope").agg(F.count(F.lit(1)).alias("num_codebooks"), ratio(F.sum("s"), F.sum("n")).alias("avg_nll"), F.max("rate").alias("rate"))
    return out.withColumn("kbps", kbits_per_second(F.col("avg_nll"), F.col("rate"), F.col("num_codebooks"))).drop("rate")


def nll_breakdown(metrics: DataFrame, by: Sequence[str], frame_rate: Column) -> DataFrame:
    """nll_summary's rows (codebook '-') and one row per codebook, each with its share_pct of the group's total kbps."""
    groups = nll_summary(metrics, by, frame_rate).withColumn("codebook", F.lit("-"))
    cell = as_cells(metrics).where(F.col("codebook").isNotNull()).groupBy(*by, "codebook").agg(ratio(F.sum("nll_sum"), F.sum("nll_n")).alias("avg_nll"), F.max(frame_rate).alias("rate"))
    books = cell.select(
        *by, F.when(F.col("codebook") == 0, "semantic").otherwise("audio").alias("scope"), F.lit(1).cast("long").alias("num_codebooks"), "avg_nll",
        kbits_per_second(F.col("avg_nll"), F.col("rate"), F.lit(1)).alias("kbps"), F.lpad(F.col("codebook").cast("string"), 2, "0").alias("codebook"),
    )
    total = F.max(F.when(F.col("scope") == "total", F.col("kbps"))).over(Window.partitionBy(*by))
    return groups.unionByName(books).withColumn("share_pct", ratio(100 * F.col("kbps"), total))


def codebook_entropy(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean entropy in bits of each codebook."""
    return as_cells(metrics).groupBy(*by, "codebook").agg((_mean("entropy") / F.ln(F.lit(2.0))).alias("entropy_bits"))


def group_entropy(metrics: DataFrame, by: Sequence[str], codebooks: Column, latest: bool = False) -> DataFrame:
    """Mean entropy in bits per frame (by) of three groups of codebooks: columns semantic, audio_half_1, audio_half_2.

    The halves are codebooks 1 to K div 2 and those after it; null where a half has no codebook. latest:
    only each sequence's last computation; by then holds model, row_id and seq_id.
    """
    bits = finite(F.col("entropy")) / F.ln(F.lit(2.0))
    k, mid = F.col("codebook"), F.floor(codebooks / 2)
    out = metrics.groupBy(*by, *(["computed_at"] if latest else [])).agg(
        F.avg(F.when(k == 0, bits)).alias("semantic"), F.avg(F.when((k >= 1) & (k <= mid), bits)).alias("audio_half_1"), F.avg(F.when(k > mid, bits)).alias("audio_half_2"),
    )
    return _last_run(out).drop("computed_at") if latest else out


def group_frame_records(groups: DataFrame, keys: Sequence[str], frame: str, frame_rate: Column | None = None) -> DataFrame:
    """group_entropy's columns as rows: keys, x (frame number, or seconds with a frame rate), scope, entropy_bits."""
    x = F.col(frame).cast("double") if frame_rate is None else F.col(frame) / frame_rate
    wide = groups.select(*keys, x.alias("x"), "semantic", "audio_half_1", "audio_half_2")
    return wide.unpivot([*keys, "x"], ["semantic", "audio_half_1", "audio_half_2"], "scope", "entropy_bits")


def row_metrics(metrics: DataFrame) -> DataFrame:
    """Per model, row and codebook: mean entropy and NLL in bits over all frames of the row."""
    bit = F.ln(F.lit(2.0))
    return as_cells(metrics).groupBy("model", "row_id", "codebook").agg((_mean("entropy") / bit).alias("entropy_bits"), (_mean("nll") / bit).alias("nll_bits"))


def frame_offsets(metrics: DataFrame, per: int = 65_536, latest: bool = False) -> DataFrame:
    """Where each sequence's frames begin among those of its row: model, row_id, seq_id, n_frames, frame_offset. latest: as in group_entropy."""
    counts = metrics.groupBy("model", "row_id", "seq_id", *(["computed_at"] if latest else [])).agg(F.countDistinct("frame_idx").alias("n_frames"))
    counts = _last_run(counts).drop("computed_at") if latest else counts
    ends = running_sum(counts, ["model", "row_id"], F.floor(F.col("seq_id") / per), ["seq_id"], F.col("n_frames"), "__end")
    return ends.withColumn("frame_offset", F.col("__end") - F.col("n_frames")).drop("__end")


def available_rows(metrics: DataFrame, first: int | None = None) -> DataFrame:
    """The distinct rows of each model, in order of number; only the first so many with first (a limit that is the feature)."""
    rows = metrics.select("model", "row_id").distinct()
    if first is None:
        return rows
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy("model").orderBy("row_id"))).where(F.col("__k") <= first).drop("__k")


def quality_gate(metrics: DataFrame, vocabulary: Column, share: float = 0.9) -> DataFrame:
    """Per model and codebook: mean NLL, the chance level ln(vocabulary), whether the mean is below a share of it, and how far NLL exceeds entropy."""
    out = as_cells(metrics).groupBy("model", "codebook").agg(_mean("nll").alias("avg_nll"), _mean("excess").alias("excess"), F.ln(F.max(vocabulary)).alias("chance"))
    return out.select("model", "codebook", "avg_nll", "chance", (F.col("avg_nll") < share * F.col("chance")).alias("passes"), "excess")


def residual_eval(metrics: DataFrame, frame_rate: Column) -> DataFrame:
    """The frame-weighted NLL of codebooks 1 and up, per model: n_frames, avg_nll over codebooks, kbps, the worst codebook and its NLL."""
    books = as_cells(metrics).where("codebook >= 1").groupBy("model", "codebook").agg(F.sum("nll_n").alias("c"), F.max(frame_rate).alias("rate"), ratio(F.sum("nll_sum"), F.sum("nll_n")).alias("a"))
    out = books.groupBy("model").agg(F.max("c").alias("n_frames"), F.avg("a").alias("avg_nll"), F.count(F.lit(1)).alias("k"), F.max("rate").alias("rate"), F.max(F.struct("a", (-F.col("codebook")).alias("neg"))).alias("w"))
    return out.select("model", "n_frames", "avg_nll", kbits_per_second(F.col("avg_nll"), F.col("rate"), F.col("k")).alias("kbps"), (-F.col("w.neg")).alias("worst_codebook"), F.col("w.a").alias("worst_nll"))


def summary_text(rows: Sequence[Sequence[str]], head: Sequence[str]) -> str:
    """A table in Markdown, padded to equal widths: the first column to the left, the others to the right. rows: a few summary rows."""
    widths = [max(len(str(r[i])) for r in [head, *rows]) for i in range(len(head))]
    cells = lambda r: [str(c).ljust(w) if i == 0 else str(c).rjust(w) for i, (c, w) in enumerate(zip(r, widths))]
    bar = ["-" * (w + 2) if i == 0 else "-" * (w + 1) + ":" for i, w in enumerate(widths)]
    return "\n".join(["| " + " | ".join(cells(head)) + " |", "|" + "|".join(bar) + "|", *["| " + " | ".join(cells(r)) + " |" for r in rows]]) + "\n"
