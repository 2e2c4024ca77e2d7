"""Percentiles per group over any number of values, from sketches that add up.

A value is encoded as a number of the same order: of 32 bits for FLOAT, of 64 for other types, which are
taken as DOUBLE. For each binary resolution of that number there is one count-sketch: rows of signed
counters, in which a hash gives each prefix a place and a sign. The coarse resolutions are counted exactly.
Sketches of partitions, days or other row sets merge by addition, and rows are deleted by adding them with
a negative count. A percentile is found by descending from the coarsest resolution, at each step into the
half that holds the wanted rank.

Beside the counters a sketch keeps exact counts of values; when they are more than 2 * KEPT, all but
the KEPT most frequent move into the counters. So a small group is exact, and values that fill much of a group (ties)
don't disturb its counters.

Error: the rank of the answer differs from the wanted rank by less than RANK_ERROR times the number of
values, but for a chance below one in a thousand per answer; tests/llm measures it.

Shuffled are, per task and group, about 2 to 3 bytes a value or 15 to 30 KB, whichever is less; small scan
tasks are put together before, so that a task has TASK_BYTES where there is enough.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a code, and the first of them, which are counted exactly.
EXACT = {32: 13, 64: 16}
ROWS, WIDTH_BITS = 3, 9
WIDTH = 1 << WIDTH_BITS
#: Values that keep exact counts when others move into the counters.
KEPT = 512
RANK_ERROR = 0.005
#: Bytes of sketches that a task holds before it passes them on, and rows it looks at at once.
HELD_BYTES = 64 << 20
CHUNK_ROWS = 1 << 20
#: Bytes of input that a task has, about, if there are more tasks than cores.
TASK_BYTES = 128 << 20
#: Partial sketches of a key that one task merges, about; more are merged in two steps.
FAN_IN = 512
PERCENTILES = (1, 5, 25, 50, 75, 95, 99)

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 63, (64, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, (64, ROWS), dtype=np.uint64)
_DOWN = np.uint64(64 - WIDTH_BITS - 1)
_CODES = {32: (np.float32, np.uint32), 64: (np.float64, np.uint64)}


def encode(values: np.ndarray, bits: int = 32) -> np.ndarray:
    """Numbers of so many bits in the order of the values; -0.0 is 0.0."""
    real, code = _CODES[bits]
    raw = (values.astype(real) + real(0)).view(code)
    return np.where(raw >> code(bits - 1) == 1, ~raw, raw | code(1 << (bits - 1))).astype(code)


def decode(code: int, bits: int = 32) -> float:
    real, kind = _CODES[bits]
    top = 1 << (bits - 1)
    raw = code & (top - 1) if code & top else ~code & (2 * top - 1)
    return float(np.array([raw], kind).view(real)[0])


def _places(level: int, row: int, prefixes: np.ndarray) -> np.ndarray:
    """Place and, in the highest bit, sign of prefixes."""
    return ((prefixes * _A[level, row] + _B[level, row]) >> _DOWN).astype(np.int64)


class Sketch:
    __slots__ = ("bits", "levels", "codes", "counts", "exact", "counters")

    def __init__(self, bits: int = 32) -> None:
        self.bits, self.levels = bits, bits - EXACT[bits]
        self.codes, self.counts = np.zeros(0, _CODES[bits][1]), np.zeros(0, np.int64)
        self.exact: np.ndarray | None = None
        self.counters: np.ndarray | None = None

    @property
    def size(self) -> int:
        return 16 * len(self.codes) + (0 if self.exact is None else self.exact.nbytes + self.counters.nbytes)

    @property
    def total(self) -> int:
        return int(self.counts.sum()) + (0 if self.exact is None else int(self.exact.sum()))

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Adds counts (negative ones delete) of distinct codes in ascending order."""
        if len(self.codes):
            both = np.concatenate((self.codes, codes))
            codes, inverse = np.unique(both, return_inverse=True)
            counts = np.bincount(inverse, np.concatenate((self.counts, counts)), len(codes)).astype(np.int64)
        keep = counts != 0
        self.codes, self.counts = codes[keep], counts[keep].astype(np.int64)
        if len(self.codes) > 2 * KEPT:
            self._move()

    def _move(self) -> None:
        """Moves all but the KEPT most frequent values into the counters."""
        order = np.argsort(-np.abs(self.counts), kind="stable")
        stay, go = np.sort(order[:KEPT]), np.sort(order[KEPT:])
        codes, counts = self.codes[go].astype(np.uint64), self.counts[go].astype(np.float64)
        self.codes, self.counts = self.codes[stay], self.counts[stay]
        if self.exact is None:
            self.exact, self.counters = np.zeros(1 << EXACT[self.bits], np.int64), np.zeros((self.levels, ROWS, WIDTH), np.int64)
        self.exact += np.bincount((codes >> np.uint64(self.levels)).astype(np.int64), counts, len(self.exact)).astype(np.int64)
        for level in range(self.levels):
            prefixes = codes >> np.uint64(self.levels - 1 - level)
            for row in range(ROWS):
                n = np.bincount(_places(level, row, prefixes), counts, 2 * WIDTH).astype(np.int64)
                self.counters[level, row] += n[:WIDTH] - n[WIDTH:]

    def merge(self, other: Sketch) -> None:
        if other.exact is not None:
            if self.exact is None:
                self.exact, self.counters = other.exact.copy(), other.counters.copy()
            else:
                self.exact += other.exact
                self.counters += other.counters
        self.add(other.codes, other.counts)

    # ---------------------------------------------------------------- ranks

    def _count(self, level: int, prefix: int) -> float:
        """The estimated number of values in the counters with a prefix of EXACT + level + 1 bits."""
        found = []
        for row in range(ROWS):
            at = int(_places(level, row, np.array([prefix], np.uint64))[0])
            n = self.counters[level, row, at & (WIDTH - 1)]
            found.append(-n if at >> WIDTH_BITS else n)
        return float(np.median(found))

    def percentiles(self, percents: Sequence[float]) -> list[float | None]:
        """For each the value of rank ceil(percent / 100 * n); None without values."""
        n = self.total
        if n <= 0:
            return [None] * len(percents)
        below = np.concatenate(([0], np.cumsum(self.counts)))
        if self.exact is None:
            ranks = np.clip(np.ceil(np.array(percents) * n / 100), 1, n)
            return [decode(int(self.codes[i]), self.bits) for i in np.searchsorted(below[1:], ranks)]
        kept = np.bincount((self.codes.astype(np.uint64) >> np.uint64(self.levels)).astype(np.int64), self.counts, len(self.exact)).astype(np.int64)
        coarse = np.cumsum(self.exact + kept)
        return [self._descend(max(1, int(np.ceil(p * n / 100))), coarse, below) for p in percents]

    def _descend(self, rank: int, coarse: np.ndarray, below: np.ndarray) -> float:
        prefix = int(np.searchsorted(coarse, rank))
        rest = rank - (int(coarse[prefix - 1]) if prefix else 0)
        rough = float(self.exact[prefix])

        def kept(at: int, shift: int) -> int:
            first, last = np.array([at << shift, ((at + 1) << shift) - 1], np.uint64).astype(self.codes.dtype)
            return int(below[np.searchsorted(self.codes, last, "right")] - below[np.searchsorted(self.codes, first)])

        for level in range(self.levels):
            shift = self.levels - 1 - level
            left, right = self._count(level, 2 * prefix), self._count(level, 2 * prefix + 1)
            spare = (rough - left - right) / 2
            left = min(max(0.0, left + spare), max(0.0, rough))
            here = left + kept(2 * prefix, shift)
            if rest <= here:
                prefix, rough = 2 * prefix, left
            else:
                prefix, rough, rest = 2 * prefix + 1, max(0.0, rough - left), rest - here
        return decode(prefix, self.bits)

    # ---------------------------------------------------------------- bytes

    def to_bytes(self) -> bytes:
        """Codes as steps, byte by byte, and numbers in as few bytes as hold them, compressed."""
        steps = np.diff(self.codes, prepend=self.codes.dtype.type(0))
        parts = [struct.pack("<BIB", self.bits, len(self.codes), self.exact is not None), steps.view(np.uint8).reshape(len(steps), self.bits // 8).T.tobytes(), *_packed(self.counts)]
        if self.exact is not None:
            parts += [*_packed(self.exact), *_packed(self.counters.ravel())]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @classmethod
    def from_bytes(cls, data: bytes) -> Sketch:
        data = zstandard.ZstdDecompressor().decompress(data)
        bits, n, dense = struct.unpack_from("<BIB", data)
        out, at = cls(bits), 6
        width = bits // 8
        steps = np.frombuffer(data, np.uint8, width * n, at).reshape(width, n).T.copy().view(out.codes.dtype).ravel()
        out.codes = np.cumsum(steps, dtype=out.codes.dtype)
        out.counts, at = _unpacked(data, at + width * n, n)
        if dense:
            out.exact, at = _unpacked(data, at, 1 << EXACT[bits])
            flat, at = _unpacked(data, at, out.levels * ROWS * WIDTH)
            out.counters = flat.reshape(out.levels, ROWS, WIDTH)
        return out


_KINDS = (np.int8, np.int16, np.int32, np.int64)


def _packed(x: np.ndarray) -> tuple[bytes, bytes]:
    kind = next(i for i, k in enumerate(_KINDS) if not len(x) or (x.min() >= np.iinfo(k).min and x.max() <= np.iinfo(k).max))
    return bytes([kind]), x.astype(_KINDS[kind]).tobytes()


def _unpacked(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    kind = np.dtype(_KINDS[data[at]])
    return np.frombuffer(data, kind, n, at + 1).astype(np.int64), at + 1 + n * kind.itemsize


# -------------------------------------------------------------------- over tables


def _grouped(chunk: pa.Table, keys: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """The group number of each row and the keys of each group; null is a key like others."""
    ids, sizes, values = np.zeros(chunk.num_rows, np.int64), [], []
    for k in keys:
        coded = chunk.column(k).combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        values.append([None, *coded.dictionary.to_pylist()])
        ids = ids * len(values[-1]) + np.nan_to_num(coded.indices.to_numpy(zero_copy_only=False), nan=-1).astype(np.int64) + 1
    seen, numbers = np.unique(ids, return_inverse=True)
    out = []
    for g in seen.tolist():
        key = []
        for v in reversed(values):
            g, at = divmod(g, len(v))
            key.append(v[at])
        out.append(tuple(reversed(key)))
    return numbers, out


def _sketching(keys: list[str], metrics: list[str], weight: str | None, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def passed(states: dict[tuple, Sketch]) -> Iterator[pa.RecordBatch]:
        items = list(states.items())
        for i in range(0, len(items), 256):
            part = items[i : i + 256]
            columns = [pa.array([k[j] for k, _ in part], schema.field(j).type) for j in range(len(keys) + 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s.to_bytes() for _, s in part], pa.binary())], schema=schema)

    def absorb(chunk: pa.Table, states: dict[tuple, Sketch]) -> None:
        numbers, groups = _grouped(chunk, keys)
        weights = None if weight is None else chunk.column(weight).to_numpy()
        for m in metrics:
            values = chunk.column(m).to_numpy()
            bits = 8 * values.dtype.itemsize
            fine = np.isfinite(values)
            at, codes = numbers[fine], encode(values[fine], bits)
            order = np.lexsort((codes, at)) if bits == 64 else np.argsort((at.astype(np.uint64) << np.uint64(32)) | codes.astype(np.uint64), kind="stable")
            at, codes = at[order], codes[order]
            new = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (at[1:] != at[:-1])))) if len(at) else np.zeros(0, np.int64)
            counts = np.diff(new, append=len(at)) if weights is None else np.add.reduceat(weights[fine][order], new) if len(new) else new
            at, codes = at[new], codes[new]
            bounds = np.searchsorted(at, np.arange(len(groups) + 1))
            for g, key in enumerate(groups):
                lo, hi = bounds[g], bounds[g + 1]
                if hi > lo:
                    states.setdefault((*key, m), Sketch(bits)).add(codes[lo:hi], counts[lo:hi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Sketch] = {}
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                absorb(pa.Table.from_batches(waiting), states)
                waiting, rows = [], 0
                if sum(s.size for s in states.values()) > HELD_BYTES:
                    yield from passed(states)
                    states = {}
        if rows:
            absorb(pa.Table.from_batches(waiting), states)
        yield from passed(states)

    return run


def _merging(keys: list[str], out: Callable[[Sketch], list], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges rows of the same keys that follow one another; holds one sketch at a time."""
    width = len(keys)

    def row(key: tuple, state: Sketch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*key, *out(state)], schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        state: Sketch | None = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            blobs = batch.column("sketch")
            for i in range(batch.num_rows):
                key = tuple(columns[j][i] for j in range(width))
                if key != at:
                    if at is not None:
                        yield row(at, state)
                    at, state = key, None
                found = Sketch.from_bytes(blobs[i].as_py())
                if state is None:
                    state = found
                else:
                    state.merge(found)
        if at is not None:
            yield row(at, state)

    return run


def _types(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def sketches(df: DataFrame, by: Sequence[str], metrics: Sequence[str], weight: str | None = None) -> DataFrame:
    """Partial sketches: columns by, metric, sketch; several rows per group, made before any shuffle.

    Nulls, NaN and infinite values are left out. A null key is a group. weight: an integer column;
    negative ones delete. FLOAT metrics have codes of 32 bits; others are taken as DOUBLE, exact to its 53
    bits, and have codes of 64. A metric keeps its type in all states that are to be merged.
    """
    by, metrics = list(by), list(metrics)
    schema = T.StructType([*_types(df, by), T.StructField("metric", T.StringType()), T.StructField("sketch", T.BinaryType())])
    kinds = {m: "float" if isinstance(df.schema[m].dataType, T.FloatType) else "double" for m in metrics}
    values = [F.coalesce(F.col(m).cast(k), F.lit(float("nan")).cast(k)).alias(m) for m, k in kinds.items()]
    return _larger_tasks(df).select(*by, *values, *([weight] if weight else [])).mapInArrow(_sketching(by, metrics, weight, _arrow(schema)), schema)


def _larger_tasks(df: DataFrame) -> DataFrame:
    """df with scan tasks put together to TASK_BYTES, as far as there are more of them than cores; nothing is shuffled."""
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():  # counting its tasks would run it
        return df
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return df.coalesce(int(wanted)) if wanted < plan.toRdd().getNumPartitions() else df


def merged(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """One sketch per group of states; by may be fewer columns than the states were made by."""
    return _merge(states, [*by, "metric"], lambda s: [s.to_bytes()], [T.StructField("sketch", T.BinaryType())])


def percentiles(states: DataFrame, by: Sequence[str], percents: Sequence[float] = PERCENTILES) -> DataFrame:
    """Columns by, metric, n and pNN for each of percents. Groups without finite values have no row."""
    fields = [T.StructField("n", T.LongType()), *[T.StructField(f"p{p:02g}".replace(".", "_"), T.DoubleType()) for p in percents]]
    return _merge(states, [*by, "metric"], lambda s: [s.total, *s.percentiles(percents)], fields).where("n > 0")


def _merge(states: DataFrame, keys: list[str], out: Callable[[Sketch], list], fields: list[T.StructField]) -> DataFrame:
    """Two steps: tasks of up to FAN_IN neighbouring partitions first, so no key has all partial sketches in one task."""
    salted = states.select(*keys, "sketch", (F.spark_partition_id() / FAN_IN).cast("int").alias("__part"))
    schema = T.StructType([*_types(states, keys), T.StructField("sketch", T.BinaryType())])
    first = salted.repartition(*keys, "__part").sortWithinPartitions(*keys, "__part").drop("__part").mapInArrow(_merging(keys, lambda s: [s.to_bytes()], _arrow(schema)), schema)
    last = T.StructType([*_types(states, keys), *fields])
    return first.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merging(keys, out, _arrow(last)), last)
