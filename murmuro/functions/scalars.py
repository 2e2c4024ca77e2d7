"""Scalar expressions: units, formats, text measures, layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Speech outside these bounds (words per second) is taken for a collapsed turn.
MIN_WORDS_PER_SECOND, MAX_WORDS_PER_SECOND = 1.5, 5.0


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def kbits_per_second(avg_nll: Column, frame_rate: Column, codebooks: Column) -> Column:
    """The bitrate that an average negative log-likelihood (nats) of some codebooks implies."""
    return avg_nll / F.ln(F.lit(2.0)) * frame_rate * codebooks / 1000


def duration(seconds: Column) -> Column:
    """HH:MM:SS.mmm."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%06.3f", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60.0)))


def slug(name: Column) -> Column:
    """The last part of a path in lower case, anything but letters, digits, '.', '_' and '-' as one '-'."""
    return F.regexp_replace(F.lower(F.substring_index(name, "/", -1)), "[^a-z0-9._-]+", "-")


def preview(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def word_count(text: Column) -> Column:
    """Words between white space of any kind; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), F.lit(0))


def words_per_second(text: Column, seconds: Column) -> Column:
    return word_count(text) / F.greatest(seconds, F.lit(1e-6))


def is_collapsed(text: Column, seconds: Column) -> Column:
    """Whether a turn speaks too fast or too slowly for its words; false without words."""
    rate = words_per_second(text, seconds)
    return (word_count(text) > 0) & ~rate.between(MIN_WORDS_PER_SECOND, MAX_WORDS_PER_SECOND)


def sample_key(row: Column, seq: Column) -> Column:
    return F.format_string("%08d_%05d", row, seq)


def text_column(text_channel: Column, codebooks: Column) -> Column:
    """The text channel of a token grid, counted from its end where negative."""
    return F.pmod(text_channel, codebooks + 1)


def audio_channels(text_channel: Column, codebooks: Column) -> Column:
    at = text_column(text_channel, codebooks)
    return F.filter(F.sequence(F.lit(0), codebooks), lambda c: c != at)


def frame_start(start_sec: Column, frame_rate: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.floor(start_sec * frame_rate).cast("long"))


def frame_end(end_sec: Column, frame_rate: Column, most: Column) -> Column:
    return F.least(most.cast("long"), F.ceil(end_sec * frame_rate).cast("long"))


def token_budget(text_tokens: Column, most: int) -> Column:
    """Frames that a text may take: 12 a token, 32 at least, most at most."""
    return F.least(F.lit(most), F.greatest(F.lit(32), text_tokens * 12))


def mixdown(channels: Column) -> Column:
    """The mean over the channels of an array of equally long arrays."""
    n = F.size(channels)
    total = F.aggregate(F.slice(channels, 2, F.greatest(n - 1, F.lit(0))), F.get(channels, F.lit(0)), lambda acc, c: F.zip_with(acc, c, lambda a, b: a + b))
    return F.transform(total, lambda x: x / n)


def stretch(samples: Column, speed: Column) -> Column:
    """An array played at another speed: linear interpolation at steps of speed."""
    n = F.size(samples)
    out = F.greatest(F.floor(n / speed).cast("int"), F.lit(1))

    def at(i: Column) -> Column:
        x = F.when(out > 1, i * (n - 1) / (out - 1)).otherwise(F.lit(0.0))
        lo = F.floor(x).cast("int")
        hi = F.least(lo + 1, n - 1)
        part = x - lo
        return F.get(samples, lo) * (1 - part) + F.get(samples, hi) * part

    return F.transform(F.sequence(F.lit(0), out - 1), at)


def rope_row(index: Column, head_dim: Column) -> Column:
    """Where a row of interleaved rotary pairs goes: in row h*D + 2*j + p to h*D + p*D/2 + j."""
    h, within = F.floor(index / head_dim), F.pmod(index, head_dim)
    return (h * head_dim + F.pmod(within, F.lit(2)) * (head_dim / 2) + F.floor(within / 2)).cast("long")
