"""Token grids of chat templates: arrays of rows, K audio columns and one text column, and masks of the same shape.

Each builder gives a struct (tokens, mask) for one segment. A segment without codes (null) has its text
only, but for the dual layout, which needs codes and gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0), n)


def _masks(n: int, on: bool) -> Column:
    return F.array_repeat(F.lit(on), n)


def _grid(tokens: Column, mask: Column) -> Column:
    return F.struct(tokens.alias("tokens"), mask.alias("mask"))


def turn_text(speaker: Column, text: Column) -> Column:
    """The text of a turn with its speaker's number before it."""
    return F.concat(F.lit("["), speaker.cast("string"), F.lit("] "), F.regexp_replace(text, r"^(?U)\s+", ""))


def chat_text(text: Column) -> Column:
    """The text as a chat message and the start of the answer."""
    return F.concat(F.lit("<|im_start|>assistant\n"), text, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def tagged_text(speaker: Column, text: Column) -> Column:
    """The text with a speaker tag before it, unless it holds one."""
    return F.when(F.contains(text, F.lit("<|speaker:")), text).otherwise(F.concat(F.lit("<|speaker:"), speaker, F.lit("|>"), text))


def _text_rows(ids: Column, k: int) -> tuple[Column, Column]:
    return F.transform(ids, lambda t: F.concat(_zeros(k), F.array(t))), F.transform(ids, lambda t: F.concat(_masks(k, False), _masks(1, True)))


def _audio_rows(codes: Column, k: int) -> tuple[Column, Column]:
    return F.transform(codes, lambda c: F.concat(c, F.array(F.lit(0)))), F.transform(codes, lambda c: F.concat(_masks(k, True), _masks(1, False)))


def text_last(ids: Column, codes: Column, k: int, prefix: Column | None = None, eos: int = 0) -> Column:
    """Text in the last column, then audio in the K before it, then one row with eos in column 0.

    prefix: ids that stand in column 0 between text and audio, masked there only.
    """
    text, text_mask = _text_rows(ids, k)
    audio, audio_mask = _audio_rows(codes, k)
    end = F.array(F.concat(F.array(F.lit(eos)), _zeros(k)))
    end_mask = F.array(F.concat(_masks(k, True), _masks(1, False)))
    if prefix is None:
        with_audio = _grid(F.concat(text, audio, end), F.concat(text_mask, audio_mask, end_mask))
    else:
        lead = F.transform(prefix, lambda p: F.concat(F.array(p), _zeros(k)))
        lead_mask = F.transform(prefix, lambda p: F.concat(_masks(1, True), _masks(k, False)))
        with_audio = _grid(F.concat(text, lead, audio, end), F.concat(text_mask, lead_mask, audio_mask, end_mask))
    return F.when(codes.isNull(), _grid(text, text_mask)).otherwise(with_audio)


def dual_mask(main: Column, k: int, low: int, high: int) -> Column:
    """The mask of a grid whose column 0 holds text and semantic ids: always on there, on in the others where the id is semantic (low to high)."""
    return F.transform(main, lambda t: F.concat(_masks(1, True), F.array_repeat(t.between(low, high), k)))


def codec_prefix(language: Column, languages: Column, voice: Column, voices: Column, ids: dict[str, int]) -> Column:
    """The ids before audio: think, begin, language, end for a known language, else nothink, begin, end; the voice's id if known; pad, begin of audio.

    languages and voices: MAP<STRING, INT> from lower-case names. ids: think, nothink, think_bos, think_eos, pad, bos.
    """
    known = F.try_element_at(languages, F.lower(language))
    speaker = F.try_element_at(voices, F.lower(voice))
    lit = {name: F.lit(i) for name, i in ids.items()}
    head = F.when(known.isNull(), F.array(lit["nothink"], lit["think_bos"], lit["think_eos"])).otherwise(F.array(lit["think"], lit["think_bos"], known, lit["think_eos"]))
    return F.concat(head, F.when(speaker.isNull(), F.array().cast("array<int>")).otherwise(F.array(speaker)), F.array(lit["pad"], lit["bos"]))


def feature_layout(hiddens: Column, logits: Column) -> Column:
    """Struct (hidden_dim, logit_dims) of features: hiddens ARRAY<ARRAY>, logits ARRAY<ARRAY<ARRAY>> by head; null where there is no row."""
    first = lambda rows: F.size(F.get(rows, F.lit(0)))
    return F.struct(F.when(F.size(hiddens) > 0, first(hiddens)).alias("hidden_dim"), F.transform(logits, lambda h: F.when(F.size(h) > 0, first(h))).alias("logit_dims"))


def head_targets(tokens: Column, columns: Column) -> Column:
    """For each row of a grid the token that each head predicts."""
    return F.transform(tokens, lambda r: F.transform(columns, lambda c: F.get(r, c)))


def audio_slice(rows: Column, start: Column, end: Column, features: bool) -> Column:
    """Rows [start, end) of a sequence; features lie one place before the tokens they predict."""
    return F.slice(rows, start + (0 if features else 1), end - start)
