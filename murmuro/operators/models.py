"""Models behind an interface: what runs a codec, a text tokenizer and a featurizer on rows.

A backend is any object with the members of ModelBackend; it is sent to the workers, which call it on
Arrow batches. ToyBackend needs no weights: the same input gives the same output on every machine, so a
pipeline can be run and checked end to end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuro.functions.scalars import MAX_WORDS_PER_SECOND, MIN_WORDS_PER_SECOND
from murmuro.session import parallelism


class ModelBackend(Protocol):
    frame_rate: float
    num_codebooks: int
    vocabulary: int
    sample_rate: int
    #: The id of head 0 that ends a generation.
    end: int

    def text_ids(self, text: str) -> list[int]: ...

    def audio_codes(self, key: str, frames: int) -> np.ndarray:
        """(frames, num_codebooks)"""

    def logits(self, key: str, codes: np.ndarray) -> np.ndarray:
        """(frames, num_codebooks, vocabulary): what predicts each code from what comes before it."""

    def encode(self, samples: np.ndarray) -> np.ndarray:
        """(frames, num_codebooks) of one channel at sample_rate."""

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """One channel at sample_rate of (frames, num_codebooks)."""

    def next_logits(self, prompt: list[int], codes: np.ndarray, context: int) -> np.ndarray:
        """(num_codebooks, vocabulary) of the frame after codes; context: the frames of earlier turns that are heard."""


class ToyBackend:
    def __init__(self, frame_rate: float = 12.5, num_codebooks: int = 4, vocabulary: int = 16, sample_rate: int = 8000) -> None:
        self.frame_rate, self.num_codebooks, self.vocabulary, self.sample_rate = frame_rate, num_codebooks, vocabulary, sample_rate
        self.end = vocabulary - 1
        self._step = int(sample_rate / frame_rate) // num_codebooks

    def _rng(self, *key: object) -> np.random.Generator:
        return np.random.default_rng(int.from_bytes(hashlib.md5("/".join(map(str, key)).encode()).digest()[:8], "little"))

    def text_ids(self, text: str) -> list[int]:
        return list(text.encode())

    def audio_codes(self, key: str, frames: int) -> np.ndarray:
        return self._rng("codes", key).integers(0, self.vocabulary, (frames, self.num_codebooks))

    def logits(self, key: str, codes: np.ndarray) -> np.ndarray:
        out = self._rng("logits", key).normal(0, 1, (*codes.shape, self.vocabulary))
        np.put_along_axis(out, codes[..., None], np.take_along_axis(out, codes[..., None], 2) + 2, 2)
        return out

    def encode(self, samples: np.ndarray) -> np.ndarray:
        """A code is the level of a stretch of a frame; a last frame that isn't full is left out."""
        n = len(samples) // (self._step * self.num_codebooks)
        level = np.asarray(samples)[: n * self._step * self.num_codebooks].reshape(n, self.num_codebooks, self._step).mean(axis=2)
        return np.clip(np.floor((level + 1) / 2 * self.vocabulary), 0, self.vocabulary - 1).astype(np.int32)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.repeat(((np.asarray(codes) + 0.5) / self.vocabulary * 2 - 1).ravel(), self._step).astype(np.float32)

    def next_logits(self, prompt: list[int], codes: np.ndarray, context: int) -> np.ndarray:
        """Noise; the end is likely from four frames a word on, and certain after twice as many."""
        out = self._rng("next", bytes(prompt).hex(), len(codes), context).normal(0, 1, (self.num_codebooks, self.vocabulary))
        words = bytes(prompt).decode(errors="replace").split()
        out[0, self.end] = -50.0 if len(codes) < 4 * len(words) else 1.0 if len(codes) < 8 * len(words) else 50.0
        return out


# How rotary positions are stretched: turns over so many positions, below low by the factor, above high not at all.
ROPE = {"positions": 8192, "low": 1.0, "high": 4.0, "factor": 32.0}


class DepthDecoder:
    """A small transformer over the codebooks of one frame: what each residual codebook's logits are, given the frame's hidden state and the codes before it.

    weights: by the names of checkpoints.OTHER_NAMES and LAYER_NAMES ("decoder.layers.0.attn.q_proj.weight"
    and so on), rows out by columns in; audio_embeddings has a block of vocabulary rows per codebook,
    audio_head is (codebooks - 1, width, vocabulary). Position 0 is the projected hidden state, position k
    the embedded code k - 1; a position sees itself and those before it.
    """

    def __init__(self, weights: dict[str, np.ndarray], heads: int, vocabulary: int, base: float = 500_000.0) -> None:
        self.w, self.heads, self.vocabulary, self.base = {k: np.asarray(v, np.float64) for k, v in weights.items()}, heads, vocabulary, base
        self.layers = 1 + max(int(k.split(".")[2]) for k in weights if k.startswith("decoder.layers."))

    @staticmethod
    def _norm(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
        return x / np.sqrt((x**2).mean(axis=-1, keepdims=True) + 1e-5) * scale

    def _turned(self, x: np.ndarray) -> np.ndarray:
        """Interleaved pairs of (n, positions, heads, width) turned by their position; slow turns are stretched (see ROPE)."""
        n = x.shape[-1] // 2
        speed = self.base ** (-np.arange(n) / n)
        turns = ROPE["positions"] * speed / (2 * np.pi)
        mix = np.clip((turns - ROPE["low"]) / (ROPE["high"] - ROPE["low"]), 0, 1)
        angle = np.arange(x.shape[1])[:, None] * speed * (mix + (1 - mix) / ROPE["factor"])
        c, s = np.cos(angle)[:, None, :], np.sin(angle)[:, None, :]
        even, odd = x[..., 0::2], x[..., 1::2]
        return np.stack([even * c - odd * s, even * s + odd * c], axis=-1).reshape(x.shape)

    def _attended(self, x: np.ndarray, at: str) -> np.ndarray:
        n, t, _ = x.shape
        q, k, v = ((x @ self.w[f"{at}.attn.{p}_proj.weight"].T).reshape(n, t, -1, self.w[f"{at}.attn.q_proj.weight"].shape[0] // self.heads) for p in "qkv")
        q, k = self._turned(q), self._turned(k)
        k, v = (np.repeat(y, q.shape[2] // y.shape[2], axis=2) for y in (k, v))
        score = np.einsum("nqhd,nkhd->nhqk", q, k) / np.sqrt(q.shape[-1])
        score = np.where(np.tril(np.ones((t, t), bool)), score, -np.inf)
        p = np.exp(score - score.max(axis=-1, keepdims=True))
        out = np.einsum("nhqk,nkhd->nqhd", p / p.sum(axis=-1, keepdims=True), v)
        return out.reshape(n, t, -1) @ self.w[f"{at}.attn.output_proj.weight"].T

    def logits(self, hiddens: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """(frames, codebooks - 1, vocabulary) of hidden states (frames, width) and codes (frames, codebooks); the last code isn't read."""
        hiddens, targets = np.asarray(hiddens, np.float64), np.asarray(targets)
        k = targets.shape[1]
        embedded = self.w["audio_embeddings.weight"][targets[:, : k - 1] + np.arange(k - 1) * self.vocabulary]
        x = np.concatenate([hiddens[:, None], embedded], axis=1) @ self.w["projection.weight"].T
        for i in range(self.layers):
            at = f"decoder.layers.{i}"
            x = x + self._attended(self._norm(x, self.w[f"{at}.sa_norm.scale"]), at)
            y = self._norm(x, self.w[f"{at}.mlp_norm.scale"])
            gate = y @ self.w[f"{at}.mlp.w1.weight"].T
            x = x + (gate / (1 + np.exp(-gate)) * (y @ self.w[f"{at}.mlp.w3.weight"].T)) @ self.w[f"{at}.mlp.w2.weight"].T
        x = self._norm(x, self.w["decoder.norm.scale"])[:, 1:]
        return np.einsum("nkw,kwv->nkv", x, self.w["audio_head"])


def depth_scored(samples: DataFrame, decoder: DepthDecoder, keep: list[str]) -> DataFrame:
    """keep, frame_idx, targets and logits of the residual codebooks of each frame of samples (hiddens, targets), for audio_frame_metrics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hiddens, targets = (np.array(batch.column(c)[i].as_py()) for c in ("hiddens", "targets"))
                if len(targets):
                    scores = decoder.logits(hiddens, targets)
                    columns = [batch.column(c).take(pa.array([i] * len(targets))) for c in keep]
                    columns += [pa.array(np.arange(len(targets), dtype=np.int32)), _nested(targets[:, 1:].astype(np.int32)), _nested(scores)]
                    yield pa.RecordBatch.from_arrays(columns, [*keep, "frame_idx", "targets", "logits"])

    schema = T.StructType([*[samples.schema[c] for c in keep], T.StructField("frame_idx", T.IntegerType()), T.StructField("targets", T.ArrayType(T.IntegerType())), T.StructField("logits", T.ArrayType(T.ArrayType(T.DoubleType())))])
    return samples.select(*keep, "hiddens", "targets").mapInArrow(run, schema)


def encoded(samples: Column, backend: ModelBackend) -> Column:
    """Codec frames ARRAY<ARRAY<INT>> of a channel (ARRAY<FLOAT>, at the backend's rate); null for null."""

    @F.pandas_udf("array<array<int>>")
    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else [c.tolist() for c in backend.encode(np.asarray(a))] for a in arrays], dtype=object)

    return run(samples)


def decoded(codes: Column, backend: ModelBackend) -> Column:
    """The samples ARRAY<FLOAT> of codec frames; null for null."""

    @F.pandas_udf("array<float>")
    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else backend.decode(np.array([np.asarray(c) for c in a]).reshape(-1, backend.num_codebooks)) for a in arrays], dtype=object)

    return run(codes)


def generate(backend: ModelBackend, text: str, key: str, most: int, context: int = 0, temperature: float = 0.9) -> np.ndarray:
    """The frames (n, codebooks) that a text makes: drawn one after another, from noise that the key decides, until head 0 draws the end or most are there; 12 frames a token and 32 at least are allowed."""
    prompt = backend.text_ids(text)
    noise = np.random.default_rng(int.from_bytes(hashlib.md5(key.encode()).digest()[:8], "little"))
    most = min(most, max(32, 12 * len(prompt)))
    out = np.zeros((0, backend.num_codebooks), np.int32)
    while len(out) < most:
        scores = backend.next_logits(prompt, out, context)
        drawn = scores.argmax(axis=1) if temperature <= 0 else (scores / temperature + noise.gumbel(size=scores.shape)).argmax(axis=1)
        if drawn[0] == backend.end:
            break
        out = np.concatenate([out, drawn[None].astype(np.int32)])
    return out


def generated(df: DataFrame, key: str, text: str, backend: ModelBackend, most: int = 2000, temperature: float = 0.9) -> DataFrame:
    """df with codes, the frames generated for each text; null and blank texts make none. What is drawn depends on key and text only."""

    @F.pandas_udf("array<array<int>>")
    def run(keys: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None or not t.strip() else generate(backend, t, str(k), most, 0, temperature).tolist() for k, t in zip(keys, texts)], dtype=object)

    return df.withColumn("codes", run(F.col(key).cast("string"), F.col(text)))


def rendered(script: DataFrame, backend: ModelBackend, by: str = "script_id", context_s: float = 30.0, attempts: int = 3, gap_s: float = 0.3) -> DataFrame:
    """Scripts (by, turn, speaker, text) spoken turn by turn: by, turn, speaker, text, attempt, n_frames, context_turns, start_sec, duration_sec, collapsed, codes.

    A turn is spoken after the earlier turns of its script that fit context_s together (the one before
    always); a collapsed one (too fast or slow for its words) is tried again, and the last attempt is
    kept. Turns of a script depend on one another, so a script is one task's, turn by turn; only what fits
    the context is held. start_sec counts gaps of gap_s between turns. Turns with null text are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, history, start = object(), [], 0.0
        for pdf in batches:
            rows = []
            for script_id, turn, speaker, text in zip(pdf[by], pdf["turn"], pdf["speaker"], pdf["text"]):
                if script_id != at:
                    at, history, start = script_id, [], 0.0
                kept, total = [], 0.0
                for seconds in reversed(history):
                    if kept and total + seconds > context_s:
                        break
                    kept.append(seconds)
                    total += seconds
                history = kept[::-1]
                for attempt in range(1, attempts + 1):
                    codes = generate(backend, text, f"{script_id}/{turn}/{attempt}", 2000, round(total * backend.frame_rate))
                    seconds = len(codes) / backend.frame_rate
                    words = len(text.split())
                    collapsed = bool(words) and not MIN_WORDS_PER_SECOND <= words / max(seconds, 1e-6) <= MAX_WORDS_PER_SECOND
                    if not collapsed:
                        break
                rows.append((script_id, turn, speaker, text, attempt, len(codes), len(history), start, seconds, collapsed, codes.tolist()))
                history.append(seconds)
                start += seconds + gap_s
            yield pd.DataFrame(rows, columns=names)

    kinds = {f.name: f.dataType.simpleString() for f in script.schema.fields}
    schema = f"`{by}` {kinds[by]}, turn {kinds['turn']}, speaker {kinds['speaker']}, text string, attempt int, n_frames int, context_turns int, start_sec double, duration_sec double, collapsed boolean, codes array<array<int>>"
    names = [by, "turn", "speaker", "text", "attempt", "n_frames", "context_turns", "start_sec", "duration_sec", "collapsed", "codes"]
    ordered = script.where("text is not null").select(by, "turn", "speaker", "text").repartition(by).sortWithinPartitions(by, "turn")
    return ordered.mapInPandas(run, schema)


def tokenized(df: DataFrame, text: Column, backend: ModelBackend, out: str = "text_ids") -> DataFrame:
    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: backend.text_ids(t or ""))

    return df.withColumn(out, ids(text))


def _nested(array: np.ndarray) -> pa.Array:
    """An array of any dimensions as lists of lists, without a loop."""
    out = pa.array(np.ascontiguousarray(array).ravel())
    for width in reversed(array.shape[1:]):
        out = pa.ListArray.from_arrays(np.arange(0, len(out) + 1, width, dtype=np.int32), out)
    return out


def featurized(df: DataFrame, key: str, frames: str, backend: ModelBackend, at_once: int = 1024) -> DataFrame:
    """For each row and frame of its audio: key, frame_idx, targets and logits (one array per codebook). Rows without frames have none.

    Rows are dealt to tasks by stretches of at_once frames: a small table grows much here, and one row
    may hold much of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (n, at) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                k = f"{batch.column(0)[i].as_py()}/{at}"
                codes = backend.audio_codes(k, min(at_once, n - at))
                scores = backend.logits(k, codes)
                columns = [batch.column(0).take(pa.array([i] * len(codes))), pa.array(np.arange(at, at + len(codes), dtype=np.int32)), _nested(codes.astype(np.int32)), _nested(scores.astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, [key, "frame_idx", "targets", "logits"])

    schema = T.StructType([df.schema[key], T.StructField("frame_idx", T.IntegerType()), T.StructField("targets", T.ArrayType(T.IntegerType())), T.StructField("logits", T.ArrayType(T.ArrayType(T.DoubleType())))])
    stretches = df.where(F.col(frames) > 0).select(key, F.col(frames).cast("int").alias("__n")).withColumn("__at", F.explode(F.sequence(F.lit(0), F.col("__n") - 1, F.lit(at_once))))
    return stretches.repartition(parallelism(df.sparkSession), key, "__at").mapInArrow(run, schema)


def audio_cache(cache: np.ndarray, start: int, end: int) -> np.ndarray | None:
    """(frames, layers, 2, heads, dim) of a cache (layers, 2, batch, heads, length, dim) at the positions that predict [start, end); None if it doesn't reach so far."""
    if start < 1 or end <= start or cache.ndim != 6 or cache.shape[4] < end - 1:
        return None
    return np.transpose(cache[:, :, 0, :, start - 1 : end - 1, :], (3, 0, 1, 2, 4))


def loess(df: DataFrame, by: list[str], x: str, y: str, bandwidth: float = 0.05, most: int = 4096) -> DataFrame:
    """Local linear regression with tricube weights per group: by, x, trend, one row per point with finite x and y.

    A regression takes the share bandwidth of the group's points nearest to its place. It is made at the
    means of up to `most` cells of equal width in x (with the number of their points as weight), so a group of
    any size is a bounded number of regressions; between two means the trend is a straight line, beyond the
    first and last it goes on with their slope. Only the cells of a group come into one task.
    """
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    kept = df.where(finite(x) & finite(y)).select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    ends = kept.groupBy(*by).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"k.{c}").eqNullSafe(F.col(f"e.{c}"))
    cell = F.least(F.floor((F.col("__x") - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-300)) * most), F.lit(most - 1))
    placed = kept.alias("k").join(ends.alias("e"), same).select("k.*", cell.cast("int").alias("__cell"))
    cells = placed.groupBy(*by, "__cell").agg(F.avg("__x").alias("x"), F.avg("__y").alias("y"), F.count(F.lit(1)).alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__cell")
        xs, ys, ns = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy(float)
        upto = np.concatenate(([0.0], np.cumsum(ns)))
        near = max(2.0, np.ceil(bandwidth * upto[-1]))
        trend, slopes = np.empty(len(xs)), np.zeros(len(xs))
        for i, at in enumerate(xs):
            lo = min(max(0, int(np.searchsorted(upto, upto[i] - near, "right")) - 1), max(0, i - 2))
            hi = max(min(len(xs), int(np.searchsorted(upto, upto[i + 1] + near))), min(len(xs), i + 3))
            d, n = np.abs(xs[lo:hi] - at), ns[lo:hi]
            order = np.argsort(d, kind="stable")
            last = min(int(np.searchsorted(np.cumsum(n[order]), near)) + 1, len(d) - 1)
            width = max(d[order[max(last, min(2, len(d) - 1))]], 1e-12)
            w = np.clip(1 - (d / width) ** 3, 0, None) ** 3 * n
            w = w if w.sum() > 0 else n
            mx, my = np.average(xs[lo:hi], weights=w), np.average(ys[lo:hi], weights=w)
            var = np.average((xs[lo:hi] - mx) ** 2, weights=w)
            slopes[i] = np.average((xs[lo:hi] - mx) * (ys[lo:hi] - my), weights=w) / var if var > 0 else 0.0
            trend[i] = my + slopes[i] * (at - mx)
        rises = np.diff(trend) / np.maximum(np.diff(xs), 1e-300)
        left, right = np.concatenate((slopes[:1], rises)), np.concatenate((rises, slopes[-1:]))
        return pdf[[*by, "__cell"]].assign(__at=xs, __trend=trend, __left=left, __right=right)

    types = dict(df.dtypes)
    fitted = cells.groupBy(*by).applyInPandas(fit, "".join(f"`{c}` {types[c]}, " for c in by) + "__cell int, __at double, __trend double, __left double, __right double")
    same = F.col("k.__cell") == F.col("e.__cell")
    for c in by:
        same = same & F.col(f"k.{c}").eqNullSafe(F.col(f"e.{c}"))
    away = F.col("__x") - F.col("__at")
    return placed.alias("k").join(fitted.alias("e"), same).select(*[f"k.{c}" for c in by], F.col("__x").alias("x"), (F.col("__trend") + away * F.when(away < 0, F.col("__left")).otherwise(F.col("__right"))).alias("trend"))


def token_rows(spark: SparkSession, backend: ModelBackend, name: str = "token_rows") -> None:
    """Registers a table function name(text): pos and token of each id of a text, for LATERAL joins in SQL; null texts have none."""

    @F.udtf(returnType="pos int, token int")
    class TokenRows:
        def eval(self, text: str):
            for pos, token in enumerate(backend.text_ids(text) if text is not None else ()):
                yield pos, token

    spark.udtf.register(name, TokenRows)


def audio_chunks(samples: Column, size: int) -> Column:
    """An array of samples as chunks of size, the last as long as is left; no chunk of an empty array."""
    n = F.size(samples)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(samples, at + 1, F.lit(size)))


def chunk_size(seconds: float, sample_rate: int, frame_rate: float) -> int:
    """Samples of the longest chunk of at most so many seconds that is whole frames; a frame at least."""
    frame = round(sample_rate / frame_rate)
    return max(frame, int(seconds * sample_rate) // frame * frame)
