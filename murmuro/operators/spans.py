"""Spans on token sequences: offsets, checks, slices, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("text", "audio", "special")
SEQUENCE = ["model", "row_id", "seq_id"]


def kind_of(kind: Column) -> Column:
    """text, audio or special; null for anything else."""
    plain = F.lower(F.trim(kind))
    return F.when(plain.isin(*KINDS), plain)


def spans_once(spans: DataFrame) -> DataFrame:
    """Each span once, of copies the one that names its segment, its kind spelled evenly: model, row_id, seq_id, span_no, kind, source_dataset_id, segment_id, span_start, span_end."""
    key = [F.lower(F.trim("model")).alias("model"), "row_id", "seq_id", "span_no"]
    row = F.struct("span_start", "span_end", kind_of(F.col("span_kind")).alias("kind"), "source_dataset_id", F.col("segment_id").isNull().alias("unknown"), "segment_id")
    return spans.groupBy(*key).agg(F.min(row).alias("r")).select(*SEQUENCE, "span_no", "r.kind", "r.source_dataset_id", "r.segment_id", "r.span_start", "r.span_end")


def spans_of(spans: DataFrame, kind: str) -> DataFrame:
    return spans.where(F.col("kind") == kind)


def sequence_lengths(spans: DataFrame) -> DataFrame:
    """model, row_id, seq_id, n_tokens: where the last span ends."""
    return spans.groupBy(*SEQUENCE).agg(F.max("span_end").alias("n_tokens"))


def offsets(spans: DataFrame) -> DataFrame:
    """Adds offset: the tokens of the spans before each span of its sequence, in order of span_no. A sequence is bounded by its model's limit."""
    before = Window.partitionBy(*SEQUENCE).orderBy("span_no").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("offset", F.coalesce(F.sum(F.col("span_end") - F.col("span_start")).over(before), F.lit(0)))


def feature_slices(spans: DataFrame) -> DataFrame:
    """Audio spans with feature_start and feature_end: position t of the features predicts token t + 1. Spans that start at 0 have no feature before them and are left out."""
    audio = spans_of(spans, "audio").where("span_start >= 1 and span_end > span_start")
    return audio.withColumns({"feature_start": F.col("span_start") - 1, "feature_end": F.col("span_end") - 1})


def teacher_forced(features: DataFrame, tokens: DataFrame, by: list[str]) -> DataFrame:
    """Features joined with the token they predict: feature_pos = pos - 1."""
    return features.join(tokens.withColumn("feature_pos", F.col("pos") - 1).drop("pos"), [*by, "feature_pos"])


def check_spans(spans: DataFrame) -> DataFrame:
    """Adds reason: kind, empty, negative, first (an audio span at 0) or ok."""
    reason = (
        F.when(F.col("kind").isNull(), "kind").when(F.col("span_start").isNull() | F.col("span_end").isNull() | (F.col("span_end") <= F.col("span_start")), "empty")
        .when(F.col("span_start") < 0, "negative").when((F.col("kind") == "audio") & (F.col("span_start") == 0), "first").otherwise("ok")
    )
    return spans.withColumn("reason", reason)


def pivot_kinds(spans: DataFrame) -> DataFrame:
    """One row per segment of a recording, model and sequence: where its text and audio lie; of several spans of a kind the last."""
    last = lambda kind, what: F.max_by(F.when(F.col("kind") == kind, F.col(what)), F.when(F.col("kind") == kind, F.col("span_start"))).alias(f"{kind}_{what[5:]}")
    known = spans.where("segment_id is not null")
    return known.groupBy(*SEQUENCE, "source_dataset_id", "segment_id").agg(*[last(k, w) for k in ("text", "audio") for w in ("span_start", "span_end")])


def template(segments: DataFrame, text_tokens: Column, frames: Column, prefix: int, suffix: int, order: list[str], by: list[str]) -> DataFrame:
    """The spans of a chat template, one sequence per by: text, prefix special tokens, audio, suffix special tokens.

    A segment without frames (null or 0) has its text only. Adds piece, kind, span_start and span_end.
    A prefix or suffix of 0 has no span.
    """
    has = F.coalesce(frames, F.lit(0)) > 0
    sizes = ((0, "text", text_tokens), (1, "special", F.when(has, F.lit(prefix)).otherwise(0)), (2, "audio", F.when(has, frames).otherwise(0)), (3, "special", F.when(has, F.lit(suffix)).otherwise(0)))
    pieces = F.array(*[F.struct(F.lit(i).alias("piece"), F.lit(kind).alias("kind"), n.cast("long").alias("n")) for i, kind, n in sizes])
    flat = segments.withColumn("__p", F.explode(pieces)).where("__p.n > 0")
    before = Window.partitionBy(*by).orderBy(*order, "__p.piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = flat.withColumn("span_start", F.coalesce(F.sum("__p.n").over(before), F.lit(0)))
    return placed.withColumns({"piece": F.col("__p.piece"), "kind": F.col("__p.kind"), "span_end": F.col("span_start") + F.col("__p.n")}).drop("__p")


# Reasons why a row of a token grid is unsound, the gravest last.
GRID_REASONS = ("ok", "audio", "text", "shape")


def check_row(tokens: Column, mask: Column, codebooks: Column, text_at: Column) -> Column:
    """The place in GRID_REASONS of one row of a token grid.

    shape: not K + 1 tokens and masks; text: a text token where its mask is off; audio: an audio token
    where no audio mask is on.
    """
    cells = F.zip_with(tokens, mask, lambda t, m: F.struct(t.alias("t"), m.alias("m")))
    audio = F.filter(cells, lambda c, i: i != text_at)
    silent = F.exists(audio, lambda c: c["m"]) | F.forall(audio, lambda c: c["t"] == 0)
    text = F.get(mask, text_at) | (F.get(tokens, text_at) == 0)
    return F.when((F.size(tokens) != codebooks + 1) | (F.size(mask) != codebooks + 1), 3).when(~text, 2).when(~silent, 1).otherwise(0)


def check_grid(tokens: Column, mask: Column, codebooks: Column, text_at: Column) -> Column:
    """The gravest of check_row's reasons over the rows of a grid; shape if tokens and masks differ in number."""
    rows = F.zip_with(tokens, mask, lambda t, m: check_row(t, m, codebooks, text_at))
    worst = F.when(F.size(tokens) != F.size(mask), 3).otherwise(F.coalesce(F.array_max(rows), F.lit(0)))
    return F.get(F.array(*[F.lit(r) for r in GRID_REASONS]), worst)


def scatter(values: DataFrame, lengths: DataFrame, by: list[str], position: str, value: str) -> DataFrame:
    """Every position of every sequence, with value, 0 where there is none. lengths: by, n."""
    grid = lengths.where("n > 0").withColumn(position, F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))).drop("n")
    return grid.join(values, [*by, position], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
