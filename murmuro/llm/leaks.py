"""Held-out passages in a corpus, found by spaced seeds.

A seed is a fixed mask over a window of words; what it hashes are the words at the mask's places, so a
changed word at another place doesn't hide the window. The hashes of all windows of the test items are
joined with those of all windows of the corpus, and around each hit the two texts are laid side by
side, the whole item, and compared word by word with room for substitutions. Where every overlap of OVERLAP
words with changes is wanted, the seeds are RUN words in a row, which each such overlap has.

The corpus is read once. A filter of the test hashes (a Bloom filter, built in segments by tasks, of a bounded
size) drops most other windows there; what is left is joined with the test hashes by value, in PARTS parts
a hash, so a passage that very many documents hold is many tasks'. Neither texts nor hits reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuro.llm.lookalike import learn, rewrite
from murmuro.session import store

#: Words that must follow one another for a leak.
WINDOW = 12
# The masks; 1 is hashed, 0 is passed over.
MASKS = ("111011010111", "110110111011", "101101101101")
#: Bits of the filter of test hashes that is sent to the workers, for each hash and at most (then it lets more
#: through, and the join does the rest), and the bits that are looked at for a hash.
FILTER_BITS, MOST_FILTER_BITS, PROBES = 32, 1 << 31, 6
#: Parts that the windows of one hash are dealt to in the join.
PARTS = 16
#: Words whose codes a worker remembers.
REMEMBERED = 1_000_000
#: One changed word in so many is allowed within a tolerant overlap.
CHANGED_ONE_IN = 6
#: Words of the shortest tolerant overlap that is looked for, and the words in a row that every tolerant overlap of that length or more has somewhere.
OVERLAP, RUN = 8, 4

_MARKS = re.compile(r"[\W_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (np.arange(1, 4 * WINDOW + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def words_of(text: str | None, table: frozenset) -> list[str]:
    """The words of a text in one consistent form, without case and punctuation."""
    if not text:
        return []
    return _MARKS.sub(" ", rewrite(text, table).casefold()).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def seed_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every window of len(mask) word numbers."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    scattered = _mix(ids.astype(np.uint64) * _STEP)
    out = np.full(n, len(mask), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out += scattered[j : j + n] * _SEEDS[j]
    return _mix(out)


def masks_for(length: int, tolerant: bool = False) -> list[str]:
    """The masks for items of a length: short items are taken whole, by the masks' beginnings. tolerant: RUN words in a row."""
    if tolerant:
        return ["1" * min(length, RUN)]
    if length >= WINDOW:
        return list(MASKS)
    return sorted({m[:length] for m in MASKS})


_known: dict[str, int] = {}


def word_codes(words: list[str]) -> np.ndarray:
    """A number of 64 bits, never 0, for each word."""
    if len(_known) > REMEMBERED:
        _known.clear()
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        code = _known.get(w)
        if code is None:
            code = _known[w] = xxhash.xxh3_64_intdigest(w) or 1
        out[i] = code
    return out


# ------------------------------------------------------------------ the filter


def probe(hashes: np.ndarray, bits: int, number: int) -> np.ndarray:
    """The place of each hash in a filter of 2 ** bits bits; each number of probe has its own."""
    return (hashes * _SEEDS[number]) >> np.uint64(64 - bits)


def held(filter_: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """The places of hashes that a filter may hold; none that it holds is left out."""
    kept = np.arange(len(hashes))
    for number in range(PROBES):
        at = probe(hashes, bits, number)
        fits = (filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        kept, hashes = kept[fits], hashes[fits]
    return kept


def filter_of(seeds: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """The filter of a column of hashes, and the logarithm of its size: FILTER_BITS a hash, MOST_FILTER_BITS at most."""
    bits = int(np.clip(np.ceil(np.log2(max(1, n) * FILTER_BITS)), 16, np.log2(MOST_FILTER_BITS)))
    segment = min(bits, 20)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, np.ndarray] = {}
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            at = np.concatenate([probe(hashes, bits, number) for number in range(PROBES)])
            for s in np.unique(at >> np.uint64(segment)).tolist():
                own = places.setdefault(s, np.zeros(1 << (segment - 3), np.uint8))
                inner = (at[at >> np.uint64(segment) == s] & np.uint64((1 << segment) - 1)).astype(np.int64)
                np.bitwise_or.at(own, inner >> 3, (1 << (inner & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(places), pa.int64()), pa.array([x.tobytes() for x in places.values()], pa.binary())], ["segment", "bits"])

    # each task makes its hashes' part of each segment; these are put together, a segment's in one task
    made = seeds.select("hash").mapInArrow(build, "segment long, bits binary")

    @F.pandas_udf("binary")
    def either(parts: pd.Series) -> bytes:
        return np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in parts]).tobytes()

    out = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (segment - 3)
    for r in made.groupBy("segment").agg(either("bits").alias("bits")).toLocalIterator():
        out[r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return out, bits


# ------------------------------------------------------------------ hits and overlaps


def longest_run(same: np.ndarray) -> tuple[int, int]:
    """Length and start of the longest run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
    if not len(edges):
        return 0, 0
    lengths = edges[1::2] - edges[::2]
    best = int(lengths.argmax())
    return int(lengths[best]), int(edges[2 * best])


def tolerant_overlap(same: np.ndarray, start: int | None = None, length: int = 0) -> int:
    """Words of the longest overlap with one change in CHANGED_ONE_IN words at most, which holds the run [start, start + length) if start is given; it begins and ends with words that agree."""
    first, last = (len(same), 0) if start is None else (start, start + length)
    good = np.concatenate(([0], np.cumsum(np.where(same, 1, 1 - CHANGED_ONE_IN))))
    begins, ends = np.flatnonzero(same[: first + 1]), last + np.flatnonzero(np.concatenate(([True], same[last:])))
    if not len(begins):
        return length
    at = np.searchsorted(-np.minimum.accumulate(good[begins]), -good[ends])  # the first begin from which an end is reached
    fits = at < len(begins)
    return max(length, int((ends[fits] - begins[at[fits]]).max(initial=0)))


def _wording(table: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """n, id and words of test items (n, id, text) that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [word_codes(words_of(t, table.value)) for t in batch.column(2).to_pylist()]
            kept = [i for i, c in enumerate(codes) if len(c)]
            words = pa.array([codes[i].view(np.int64) for i in kept], pa.list_(pa.int64()))
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), words], ["n", "id", "words"])

    return run


def _seeding(tolerant: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """hash, n and place of every window of test items (n, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ns, places = [], [], []
            for n, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.values.to_numpy().view(np.uint64)
                for mask in masks_for(len(ids), tolerant):
                    h = seed_hashes(ids, mask)
                    hashes.append(h)
                    ns.append(np.full(len(h), n))
                    places.append(np.arange(len(h), dtype=np.int32))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(ns), pa.int64()), pa.array(np.concatenate(places))], ["hash", "n", "place"])

    return run


def _hitting(table: Broadcast, masks: list[str], sieve: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc, words and hits (hash, place) of documents (doc, text) with a window that the filter lets through."""
    gap = np.zeros(WINDOW, np.uint64)
    kinds = pa.list_(pa.struct({"hash": pa.int64(), "place": pa.int32()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, bits = sieve.value
        forms = table.value
        for batch in batches:
            texts = [word_codes(words_of(t, forms)) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            begins = np.cumsum(sizes + WINDOW) - (sizes + WINDOW)
            whole = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap
            found, where = [], []
            for mask in masks:
                h = seed_hashes(whole, mask)
                at = held(filter_, bits, h)
                found.append(h[at])
                where.append(at)
            hashes, at = np.concatenate(found), np.concatenate(where)
            order = np.argsort(at, kind="stable")
            hashes, at = hashes[order], at[order]
            text = np.searchsorted(begins, at, "right") - 1
            inside = at - begins[text] < sizes[text]
            hashes, at, text = hashes[inside], at[inside], text[inside]
            docs, first = np.unique(text, return_index=True)
            ends = pa.array(np.append(first, len(text)), pa.int32())
            hits = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array((at - begins[text]).astype(np.int32))], ["hash", "place"])).cast(kinds)
            words = pa.array([texts[i].view(np.int64) for i in docs], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int64())), words, hits], ["doc", "words", "hits"])

    return run


def _comparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """m, n, words in a row and words with changes of an item (words) and the part of a document beside it (beside), from the item's word lo on."""
    for batch in batches:
        rows, changes = [], []
        for words, beside, lo in zip(batch.column("words"), batch.column("beside"), batch.column("lo").to_pylist()):
            b = beside.values.to_numpy()
            same = words.values.to_numpy()[lo : lo + len(b)] == b
            rows.append(longest_run(same)[0])
            changes.append(tolerant_overlap(same))
        yield pa.RecordBatch.from_arrays([batch.column("m"), batch.column("n"), pa.array(rows, pa.int32()), pa.array(changes, pa.int32())], ["m", "n", "words_in_row", "words_with_changes"])


def find(corpus: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", tolerant: bool = False) -> DataFrame:
    """Rows (doc, item, item_words, words_in_row, words_with_changes) for each document that shares a seed with an item.

    No pair with WINDOW words in a row, or with a whole shorter item, is missed; with tolerant, none with OVERLAP words with changes either.
    Null and blank texts and items without words match nothing. Repeated documents and items are
    reported each. The words of a text are told apart by 64 bits.
    """
    spark = corpus.sparkSession
    table = spark.sparkContext.broadcast(learn(corpus.select(text).unionByName(items.select(text)), text))
    listed = items.select(F.monotonically_increasing_id().alias("n"), F.col(item).alias("id"), F.col(text).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in [*corpus.select(doc).schema.fields, *items.select(item).schema.fields]}
    known = store(listed.mapInArrow(_wording(table), f"n long, id {kinds[item]}, words array<long>"), "items")
    lengths = [r[0] for r in known.select(F.least(F.size("words"), F.lit(WINDOW)).alias("k")).distinct().collect()]
    masks = sorted({m for k in lengths for m in masks_for(k, tolerant)})
    seeds = store(known.select("n", "words").mapInArrow(_seeding(tolerant), "hash long, n long, place int"), "seeds")
    sieve = spark.sparkContext.broadcast(filter_of(seeds, seeds.count()))
    hit = corpus.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(_hitting(table, masks, sieve), f"doc {kinds[doc]}, words array<long>, hits array<struct<hash: bigint, place: int>>") if masks else None
    if hit is None:
        return spark.createDataFrame([], T.StructType([corpus.schema[doc], items.schema[item], *[T.StructField(c, T.IntegerType()) for c in ("item_words", "words_in_row", "words_with_changes")]]))
    hit = store(hit.withColumn("m", F.monotonically_increasing_id()), "hits")
    windows = hit.select("m", F.explode("hits").alias("h")).select("m", "h.hash", "h.place", F.pmod("m", F.lit(PARTS)).cast("int").alias("part"))
    dealt = seeds.select("hash", "n", F.col("place").alias("own"), F.explode(F.array(*[F.lit(i) for i in range(PARTS)])).alias("part"))
    shifts = windows.join(dealt, ["hash", "part"]).groupBy("m", "n").agg(F.collect_set(F.col("place") - F.col("own")).alias("shifts"))
    pairs = shifts.join(known.select("n", F.col("words")), "n").join(hit.select("m", F.col("words").alias("all")), "m")
    at = pairs.select("m", "n", "words", "all", F.explode("shifts").alias("shift"))
    lo, first = F.greatest(-F.col("shift"), F.lit(0)), F.greatest(F.col("shift"), F.lit(0))
    beside = F.slice("all", first + 1, F.greatest(F.least(F.size("words") + F.col("shift"), F.size("all")) - first, F.lit(0)))
    judged = at.select("m", "n", "words", beside.alias("beside"), lo.alias("lo")).mapInArrow(_comparing, "m long, n long, words_in_row int, words_with_changes int")
    best = judged.groupBy("m", "n").agg(F.max("words_in_row").alias("words_in_row"), F.max("words_with_changes").alias("words_with_changes")).where("words_in_row > 0")
    named = best.join(known.select("n", F.col("id").alias("__item"), F.size("words").alias("item_words")), "n").join(hit.select("m", F.col("doc").alias("__doc")), "m")
    return named.select(F.col("__doc").alias(doc), F.col("__item").alias(item), "item_words", "words_in_row", "words_with_changes")


def leaked(found: DataFrame) -> DataFrame:
    """The pairs with WINDOW words in a row, or the whole item where it has fewer."""
    return found.where(F.col("words_in_row") >= F.least(F.lit(WINDOW), F.col("item_words")))
