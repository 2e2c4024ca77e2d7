"""Sound files as rows, and rows as sound files."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.sources import files

_KINDS = {1: np.uint8, 2: np.int16, 4: np.int32}


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """(channels, samples) from -1 to 1, and the sample rate, of a PCM wave file."""
    with wave.open(io.BytesIO(data)) as w:
        raw = np.frombuffer(w.readframes(w.getnframes()), _KINDS[w.getsampwidth()]).reshape(-1, w.getnchannels()).T
        scale = float(1 << (8 * w.getsampwidth() - 1))
        return (raw.astype(np.float32) - (128 if w.getsampwidth() == 1 else 0)) / scale, w.getframerate()


def encode(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit wave file of (channels, samples) or (samples, channels): the longer side is time. Values beyond -1 and 1 are cut off."""
    samples = np.atleast_2d(np.asarray(samples, np.float32))
    if samples.shape[0] > samples.shape[1]:
        samples = samples.T
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[0])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").T.tobytes())
    return out.getvalue()


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, data in zip(pdf["path"], pdf["content"]):
            samples, rate = decode(data)
            yield pd.DataFrame({"path": path, "channel": np.arange(len(samples), dtype=np.int32), "sample_rate": np.int32(rate), "samples": list(samples)})


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """path, channel, sample_rate, samples (ARRAY<FLOAT>), one row per channel. The payload is read only if samples are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(_rows, "path string, channel int, sample_rate int, samples array<float>")


def write_wav(df: DataFrame, folder: str) -> DataFrame:
    """Writes each row's samples (name, sample_rate, samples) as folder/name.wav; gives name and n_samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, rate, samples in zip(pdf["name"], pdf["sample_rate"], pdf["samples"]):
                with files.written(f"{folder}/{name}.wav") as f:
                    f.write(encode(np.asarray(samples), int(rate)))
            yield pd.DataFrame({"name": pdf["name"], "n_samples": [len(s) for s in pdf["samples"]]})

    return df.select("name", "sample_rate", "samples").mapInPandas(run, "name string, n_samples long")


#: Half the length of the filter in samples of the slower rate, and the shape of its Kaiser window.
HALF_LENGTH, BETA = 10, 5.0


def resample(samples: np.ndarray, source_rate: int, target_rate: int) -> np.ndarray:
    """A channel at another rate, by a polyphase windowed-sinc filter; ceil(n * target / source) samples."""
    samples = np.asarray(samples, np.float64)
    shared = math.gcd(source_rate, target_rate)
    up, down = target_rate // shared, source_rate // shared
    if up == down or not len(samples):
        return samples.astype(np.float32)
    most = max(up, down)
    half = HALF_LENGTH * most
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / most) * np.kaiser(2 * half + 1, BETA)
    taps *= up / taps.sum()
    n_out = -(-len(samples) * up // down)
    out = np.empty(n_out)
    width = 2 * half // up + 2
    for lo in range(0, n_out, 1 << 15):
        centre = np.arange(lo, min(n_out, lo + (1 << 15))) * down
        first = -(-(centre - half) // up)
        k = first[:, None] + np.arange(width)
        place = centre[:, None] - k * up + half
        fits = (k >= 0) & (k < len(samples)) & (place >= 0) & (place <= 2 * half)
        out[lo : lo + len(centre)] = np.where(fits, samples[np.clip(k, 0, len(samples) - 1)] * taps[np.clip(place, 0, 2 * half)], 0).sum(axis=1)
    return out.astype(np.float32)


def resampled_to(samples: Column, source_rate: Column, target_rate: int) -> Column:
    """Samples (ARRAY<FLOAT>) at another rate; null for null and for rates that aren't positive."""

    @F.pandas_udf("array<float>")
    def run(arrays: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or not r > 0 else resample(np.asarray(a), int(r), target_rate) for a, r in zip(arrays, rates)], dtype=object)

    return run(samples, source_rate)


def decoded_payloads(rows: DataFrame, keep: list[str], payload: str = "audio") -> DataFrame:
    """keep, channel, sample_rate, samples of each row's payload, a struct (bytes BINARY, path STRING, array ARRAY<ARRAY<FLOAT>>, sampling_rate INT).

    The first of bytes, path and array that is there counts. An array is channels of samples, or samples of
    channels where it has more rows than columns. Rows without any have a row with null samples.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                data, path, array, rate = (pdf[c].iloc[i] for c in ("__bytes", "__path", "__array", "__rate"))
                if data is not None:
                    found, rate = decode(data)
                elif path:
                    found, rate = decode(files.read(path))
                elif array is not None and len(array):
                    found = np.array([np.asarray(a, np.float32) for a in array])
                    found = found.T if found.shape[0] > found.shape[1] else found
                else:
                    found, rate = None, None
                part = pdf[keep].iloc[[i] * (1 if found is None else len(found))].reset_index(drop=True)
                yield part.assign(channel=pd.array([None] if found is None else range(len(found)), "Int32"), sample_rate=pd.array([rate] * len(part), "Int32"), samples=[None] if found is None else list(found))

    parts = {"__bytes": "bytes", "__path": "path", "__array": "array", "__rate": "sampling_rate"}
    flat = rows.select(*keep, *[F.col(f"{payload}.{v}").alias(k) for k, v in parts.items()])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return flat.mapInPandas(run, f"{kinds}, channel int, sample_rate int, samples array<float>")


def with_audio(segments: DataFrame, clips: DataFrame, row: str = "source_dataset_id") -> DataFrame:
    """Segments (row, source_audio_channel_id, start_sec, end_sec) with the samples of their channel between their times, null where the recording or channel has none.

    clips: row, channel, sample_rate, samples, as read_wav or decoded_payloads give them with the row's
    number. The whole recording is one row of clips; only its slice goes on.
    """
    c = clips.select(F.col(row).alias("__row"), F.col("channel").alias("__channel"), "sample_rate", F.col("samples").alias("__samples"))
    joined = segments.join(c, (F.col(row) == F.col("__row")) & (F.col("source_audio_channel_id") == F.col("__channel")), "left")
    first = F.greatest(F.floor(F.col("start_sec") * F.col("sample_rate")), F.lit(0)).cast("int")
    last = F.least(F.ceil(F.col("end_sec") * F.col("sample_rate")), F.size("__samples")).cast("int")
    return joined.withColumn("samples", F.when(last > first, F.slice("__samples", first + 1, last - first))).drop("__row", "__channel", "__samples")
