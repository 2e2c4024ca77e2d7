"""Token sequences with their features: checks, JSON forms, and the training samples cut from them.

A token sequence is (keys, tokens ARRAY<ARRAY<INT>>, mask ARRAY<ARRAY<BOOLEAN>>, spans ARRAY<SPAN>, layout
LAYOUT), its features (keys, hiddens ARRAY<ARRAY<FLOAT>>, logits ARRAY<ARRAY<ARRAY<FLOAT>>> by head): one
row per sequence, bounded by its model's limit of tokens. Both are joined on their keys, never by place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuro.functions.grids import audio_slice
from murmuro.functions.scalars import audio_channels, sample_key, text_column
from murmuro.operators.spans import GRID_REASONS, KINDS, check_grid

# The fields of a span and of a layout in JSON.
SPAN = "struct<source_dataset_id: bigint, segment_id: int, start: int, end: int, kind: string>"
LAYOUT = "struct<num_codebooks: int, text_channel: int, head_targets: array<int>, hidden_dim: int, logit_dims: array<int>>"
KEYS = ("model", "row_id", "seq_id")


# ------------------------------------------------------------------ JSON


def to_text(value: Column) -> Column:
    """A span or layout as JSON; fields that are null, or arrays without elements, are left out of a layout by leaving them null."""
    return F.to_json(value)


def span_of(text: Column) -> Column:
    """A span from JSON; null where it is no JSON, has no such kind or lacks a place."""
    found = F.from_json(text, SPAN)
    return F.when(found["kind"].isin(*KINDS) & found["start"].isNotNull() & found["end"].isNotNull(), found)


def layout_of(text: Column) -> Column:
    """A layout from JSON, its head_targets the audio channels where it names none; null where codebooks or text channel are missing."""
    return with_targets(F.from_json(text, LAYOUT))


def with_targets(layout: Column) -> Column:
    """A layout whose head_targets are the audio channels where it has none."""
    k, targets = layout["num_codebooks"], layout["head_targets"]
    given = F.coalesce(F.size(targets), F.lit(0)) > 0
    own = F.when(given, targets).otherwise(audio_channels(layout["text_channel"], k))
    return F.when(k.isNotNull() & layout["text_channel"].isNotNull(), layout.withField("head_targets", own))


def layout_reason(layout: Column) -> Column:
    """ok, or why a layout is unsound: missing, heads (not one target per codebook), column (a target outside the grid)."""
    k, targets = layout["num_codebooks"], layout["head_targets"]
    return F.when(layout.isNull() | k.isNull() | (k < 1), "missing").when(F.coalesce(F.size(targets), F.lit(0)) != k, "heads").when(F.exists(targets, lambda c: (c < 0) | (c > k)), "column").otherwise("ok")


# ------------------------------------------------------------------ checks


def feature_reason(hiddens: Column, logits: Column, spans: Column, length: Column) -> Column:
    """ok, or why features don't fit a sequence of so many tokens: length (not one less), head (a head of another length), span (a span outside)."""
    n = F.size(hiddens)
    outside = F.exists(spans, lambda s: ~F.coalesce((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= n + 1), F.lit(False)))
    return F.when(n != length - 1, "length").when(F.exists(logits, lambda h: F.size(h) != n), "head").when(outside, "span").otherwise("ok")


def audio_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] == "audio")


def semantic_reason(targets: Column, low: int, high: int) -> Column:
    """ok, or semantic where the first target of a frame isn't an id from low to high."""
    return F.when(F.exists(targets, lambda t: ~F.coalesce(F.get(t, F.lit(0)).between(low, high), F.lit(False))), "semantic").otherwise("ok")


def usable_segments(spans: DataFrame, by: Sequence[str] = (*KEYS, "source_dataset_id", "segment_id")) -> DataFrame:
    """Segments with a text span and an audio span of at least one frame: by, text_start, text_end, audio_start, audio_end, of several spans of a kind the last. Others are passed over."""
    of = lambda kind, what: F.max_by(F.when(F.col("kind") == kind, F.col(what)), F.when(F.col("kind") == kind, F.col("span_start"))).alias(f"{kind}_{what[5:]}")
    out = spans.where("segment_id is not null").groupBy(*by).agg(*[of(k, w) for k in ("text", "audio") for w in ("span_start", "span_end")])
    return out.where("text_end > text_start and audio_end > audio_start")


# ------------------------------------------------------------------ samples


def row_samples(tokens: DataFrame, features: DataFrame, frame_rate: Column, keys: Sequence[str] = KEYS, first_k: bool = False, semantic: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Training samples (keys, key, hiddens, targets, audio_frames, meta), and the sequences that give none (keys, reason).

    A sample holds the hidden states one place before the frames of the sequence's audio span, and per
    frame the token that each head predicts (the first K columns with first_k). Reasons: not tokenized, not
    featurized, shape/text/audio (of the grid), layout, length/head/span (of the features), no audio, several
    audio, first (audio at 0), semantic (a first target outside the range semantic). Extra columns of either
    side stay where they are; key and meta (JSON) describe the sample.
    """
    keys = list(keys)
    t = tokens.select(*keys, "tokens", "mask", "spans", with_targets(F.col("layout")).alias("layout"), F.lit(True).alias("__t"))
    f = features.select(*keys, "hiddens", "logits", F.lit(True).alias("__f"))
    both = t.join(f, keys, "full")
    k, at = F.col("layout.num_codebooks"), F.get("__audio", F.lit(0))
    both = both.withColumns({"__audio": audio_of(F.col("spans")), "__grid": check_grid(F.col("tokens"), F.col("mask"), k, text_column(F.col("layout.text_channel"), k))})
    heads = F.slice(F.sequence(F.lit(0), k), F.lit(1), k) if first_k else F.col("layout.head_targets")
    rows = audio_slice(F.col("tokens"), at["start"], at["end"], features=False)
    both = both.withColumn("targets", F.when((F.size("__audio") == 1) & (at["start"] >= 1) & (at["end"] > at["start"]), F.transform(rows, lambda r: F.transform(heads, lambda c: F.get(r, c)))))
    fits = feature_reason(F.col("hiddens"), F.col("logits"), F.col("spans"), F.size("tokens"))
    reason = F.when(F.col("__t").isNull(), "not tokenized").when(F.col("__f").isNull(), "not featurized").when(layout_reason(F.col("layout")) != "ok", "layout")
    for r in GRID_REASONS[1:]:
        reason = reason.when(F.col("__grid") == r, r)
    reason = reason.when(fits != "ok", fits).when(F.size("__audio") == 0, "no audio").when(F.size("__audio") > 1, "several audio").when(at["start"] < 1, "first")
    if semantic:
        reason = reason.when(semantic_reason(F.col("targets"), *semantic) != "ok", "semantic")
    both = both.withColumn("reason", reason.otherwise("ok"))
    frames = at["end"] - at["start"]
    about = F.struct(*keys, at["source_dataset_id"].alias("source_dataset_id"), at["segment_id"].alias("segment_id"), frames.alias("audio_frames"), frame_rate.alias("frame_rate"), F.size(F.get("hiddens", F.lit(0))).alias("hidden_dim"), k.alias("num_codebooks"))
    good = both.where("reason = 'ok'").select(*keys, sample_key(F.col(keys[-2]), F.col(keys[-1])).alias("key"), F.slice("hiddens", at["start"], frames).alias("hiddens"), "targets", frames.alias("audio_frames"), F.to_json(about).alias("meta"))
    return good, both.where("reason <> 'ok'").select(*keys, "reason")


def codes_of_segments(bounds: DataFrame, codes: DataFrame, row: str, channel: str) -> DataFrame:
    """Every segment with its slice of its channel's codes, null where the recording has no codes or they end before it."""
    joined = bounds.join(codes, [row, channel], "left")
    part = F.slice("codes", F.col("frame_start").cast("int") + 1, (F.col("frame_end") - F.col("frame_start")).cast("int"))
    return joined.withColumn("codes", F.when(F.size("codes") > F.col("frame_start"), part))


def packed_frames(samples: DataFrame, by: Sequence[str], ends: str, batch: int, drop_last: bool = False) -> DataFrame:
    """Frames of all samples of a group one after another in batches: by, batch_no, hiddens, targets.

    ends: the column with the number of frames up to and with each sample, in the order wanted (see
    ordered.running_sum). A batch is an array of batch frames, so no row grows with the group; drop_last
    leaves out a last batch that isn't full.
    """
    by = list(by)
    flat = samples.select(*by, ends, F.size("targets").alias("__n"), F.posexplode(F.arrays_zip("hiddens", "targets")).alias("__i", "__x"))
    at = F.col(ends) - F.col("__n") + F.col("__i")
    placed = flat.select(*by, F.floor(at / batch).alias("batch_no"), F.struct(at.alias("at"), F.col("__x.hiddens").alias("h"), F.col("__x.targets").alias("t")).alias("x"))
    out = placed.groupBy(*by, "batch_no").agg(F.array_sort(F.collect_list("x")).alias("x"))
    out = out.select(*by, "batch_no", F.transform("x", lambda r: r["h"]).alias("hiddens"), F.transform("x", lambda r: r["t"]).alias("targets"))
    return out.where(F.size("targets") == batch) if drop_last else out
