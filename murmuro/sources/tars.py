"""Tar shards of training samples: a data source to read them, and a writer.

A sample is two arrays and a description: KEY.hiddens.npy (half floats, frames by width), KEY.targets.npy
(frames by codebooks) and KEY.meta.json. Ids of targets are kept as 32-bit integers, since vocabularies
beyond 32,767 exist.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import tarfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from murmuro.sources import files

SAMPLE = "key string, hiddens array<array<float>>, targets array<array<int>>, meta string, shard string"


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def npy_array(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


class TarPartition(InputPartition):
    def __init__(self, path: str, draw: int = 0) -> None:
        self.path, self.draw = path, draw


def samples_in(path: str) -> Iterator[tuple]:
    """Samples (as SAMPLE) in a shard's order; one without hiddens or targets is passed over. The shard is read as a stream."""
    key, parts = None, {}

    def sample() -> Iterator[tuple]:
        if "hiddens.npy" in parts and "targets.npy" in parts:
            hiddens, targets = npy_array(parts["hiddens.npy"]).astype(np.float32), npy_array(parts["targets.npy"]).astype(np.int32)
            yield key, hiddens.tolist(), targets.tolist(), parts.get("meta.json", b"{}").decode(), os.path.basename(path)

    with files.opened(path) as f, tarfile.open(fileobj=f) as tar:
        for member in tar:
            at, _, kind = os.path.basename(member.name).partition(".")
            if at != key:
                yield from sample()
                key, parts = at, {}
            parts[kind] = tar.extractfile(member).read()
    yield from sample()


class TarReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> Sequence[InputPartition]:
        return [TarPartition(p) for p in self.paths]

    def read(self, partition: TarPartition) -> Iterator[tuple]:
        return samples_in(partition.path)


class TarStream(DataSourceStreamReader):
    """Shards as a stream: so many a batch, in a shuffled order. An offset is the number of shards taken so far.

    Without replacement the order is that of md5(seed:name), and the stream has nothing new after the last
    shard; with it shard i is drawn by md5(seed:i), without end. Both depend on the seed and the
    offset only, so a batch that is run again has the same shards.
    """

    def __init__(self, paths: list[str], seed: int, per_batch: int, resampled: bool) -> None:
        self.paths, self.seed, self.per_batch, self.resampled = paths, seed, per_batch, resampled
        self.taken = 0

    def _mixed(self, of: object) -> int:
        return int(hashlib.md5(f"{self.seed}:{of}".encode()).hexdigest(), 16)

    def initialOffset(self) -> dict:
        return {"shards": 0}

    def latestOffset(self) -> dict:
        self.taken += self.per_batch
        return {"shards": self.taken if self.resampled else min(self.taken, len(self.paths))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.taken = max(self.taken, end["shards"])  # after a restart
        if self.resampled:
            return [TarPartition(self.paths[self._mixed(i) % len(self.paths)], i) for i in range(start["shards"], end["shards"])]
        order = sorted(self.paths, key=lambda p: (self._mixed(os.path.basename(p)), p))
        return [TarPartition(p, i) for i, p in enumerate(order)][start["shards"] : end["shards"]]

    def read(self, partition: TarPartition) -> Iterator[tuple]:
        for sample in samples_in(partition.path):
            yield (*sample, partition.draw)


class TarShards(DataSource):
    """spark.read or readStream .format("tar_shards").load(folder): every *.tar of a folder that all executors share, a task each.

    A stream has one column more, draw, the number of the shard in the stream's order. Options of a
    stream: seed (42), per_batch (8 shards) and resampled (false).
    """

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return f"{SAMPLE}, draw long" if self.options.get("stream") == "true" else SAMPLE

    def _paths(self) -> list[str]:
        folder = self.options["path"]
        return [f"{folder}/{n}" for n in files.names(folder, ".tar")]

    def reader(self, schema) -> TarReader:
        return TarReader(self._paths())

    def streamReader(self, schema) -> TarStream:
        found = self._paths()
        if not found:
            raise FileNotFoundError(self.options["path"])
        return TarStream(found, int(self.options.get("seed", 42)), int(self.options.get("per_batch", 8)), self.options.get("resampled", "false") == "true")


def read_tars(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(TarShards)
    return spark.read.format("tar_shards").load(folder)


def stream_tars(spark: SparkSession, folder: str, seed: int = 42, per_batch: int = 8, resampled: bool = False) -> DataFrame:
    """The samples of shards as a stream (see TarStream), with draw."""
    spark.dataSource.register(TarShards)
    options = {"stream": "true", "seed": str(seed), "per_batch": str(per_batch), "resampled": str(resampled).lower()}
    return spark.readStream.format("tar_shards").options(**options).load(folder)


def incomplete_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Per shard how many keys there are and how many lack hiddens or targets, which read_tars passes over."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["shard"]:
                kinds: dict[str, set[str]] = {}
                with files.opened(f"{folder}/{name}") as f, tarfile.open(fileobj=f) as tar:
                    for member in tar:
                        key, _, kind = os.path.basename(member.name).partition(".")
                        kinds.setdefault(key, set()).add(kind)
                yield pd.DataFrame([{"shard": name, "n_keys": len(kinds), "n_incomplete": sum(not {"hiddens.npy", "targets.npy"} <= k for k in kinds.values())}])

    found = spark.createDataFrame([(n,) for n in files.names(folder, ".tar")], "shard string")
    return found.repartition("shard").mapInPandas(run, "shard string, n_keys long, n_incomplete long")


def write_tars(df: DataFrame, folder: str, prefix: str, per_shard: int = 250) -> DataFrame:
    """Writes samples (key, hiddens, targets, meta, place) as folder/prefix_NNNNN.tar; gives shard, num_samples, total_frames.

    Sample p of the order goes to shard p div per_shard. A shard is written under another name and
    renamed when it is whole, so a task that is run again leaves no half shard.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        name = f"{prefix}_{key[0]:05d}.tar"
        frames = 0
        with files.written(f"{folder}/{name}") as f, tarfile.open(fileobj=f, mode="w|") as tar:
            for r in pdf.itertuples():
                targets = np.array([list(t) for t in r.targets], np.int32)
                frames += len(targets)
                parts = {"hiddens.npy": npy_bytes(np.array([list(h) for h in r.hiddens], np.float16)), "targets.npy": npy_bytes(targets), "meta.json": (r.meta or "{}").encode()}
                for kind, data in parts.items():
                    info = tarfile.TarInfo(f"{r.key}.{kind}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame([{"shard": name, "num_samples": len(pdf), "total_frames": frames}])

    rows = df.select("key", "hiddens", "targets", "meta", "place", F.floor(F.col("place") / per_shard).cast("int").alias("shard_no"))
    return rows.groupBy("shard_no").applyInPandas(run, "shard string, num_samples long, total_frames long")


def write_info(index: DataFrame, path: str, hidden_dim: int | None = None, num_codebooks: int | None = None) -> None:
    """Writes the shards' index, totals of a split, a few rows, and the samples' dimensions, where given, as JSON."""
    rows = [r.asDict() for r in index.orderBy("shard").collect()]
    about = {k: v for k, v in (("hidden_dim", hidden_dim), ("num_codebooks", num_codebooks)) if v is not None}
    with files.written(path) as f:
        f.write(json.dumps({"shards": rows, "num_samples": sum(r["num_samples"] for r in rows), "total_frames": sum(r["total_frames"] for r in rows), **about}, indent=2).encode())


def shard_urls(folder: str, prefix: str) -> str:
    """The shards of a prefix as one path, or with their numbers as a range in braces. Raises if there is none or one is missing in between."""
    numbers = sorted(int(n[len(prefix) + 1 : -4]) for n in files.names(folder, ".tar") if n.startswith(f"{prefix}_") and n[len(prefix) + 1 : -4].isdigit())
    if not numbers or numbers != list(range(numbers[0], numbers[-1] + 1)):
        raise FileNotFoundError(f"{folder}/{prefix}_*.tar")
    if len(numbers) == 1:
        return f"{folder}/{prefix}_{numbers[0]:05d}.tar"
    return f"{folder}/{prefix}_{{{numbers[0]:05d}..{numbers[-1]:05d}}}.tar"
