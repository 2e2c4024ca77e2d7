"""Exact byte-pair encoding of whole corpora in linear time.

Within a piece, the longest vocabulary match is found with an automaton and checked against the token
before it: two tokens may stand side by side only if merging would not have joined across their border.
Where no match is compatible, the encoder steps back and tries the next shorter token. The first
sequence that reaches the end is the one that the merge rules give. A text is decoded with a table of
offsets into one string of all tokens' bytes.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how the public byte-level tokenizers cut a text into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers; a memory bound only, ids don't depend on it.
REMEMBERED = 200_000
#: Pairs of tokens of which a worker remembers whether they fit; as above.
PAIRS = 1_000_000
NAME = "byte_bpe_50k"


def vocabulary_path(name: str = NAME, folder: str = "/opt/tokenizers") -> str:
    return f"{folder}/{name}.tiktoken"


class Encoder:
    """Encodes with a vocabulary of tokens in order of their merging."""

    def __init__(self, tokens: dict[bytes, int], pieces: str = PIECES) -> None:
        self.tokens = tokens
        self.cut = regex.compile(pieces).findall
        size = max(tokens.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in tokens.items():
            self.bytes_of[i] = t
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in self.bytes_of])))
        self.blob = b"".join(self.bytes_of)
        self.words = ahocorasick.Automaton()
        for t, i in tokens.items():
            self.words.add_word(t.decode("latin-1"), i)
        self.words.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of a token."""
        if token not in self.shorter:
            t = self.bytes_of[token]
            self.shorter[token] = next((self.tokens[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.tokens), None)
        return self.shorter[token]

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merging makes a token; the token twice for a single byte."""
        if token not in self.halves:
            found, best = (token, token), None
            t = self.bytes_of[token]
            for n in range(1, len(t)):
                a, b = self.tokens.get(t[:n]), self.tokens.get(t[n:])
                if a is not None and b is not None and a < token and b < token and self.compatible(a, b, token):
                    if best is None or max(a, b) < best:
                        found, best = (a, b), max(a, b)
            self.halves[token] = found
        return self.halves[token]

    def compatible(self, left: int, right: int, limit: int | None = None) -> bool:
        """Whether the merge rules, below a limit, leave the border between two tokens."""
        key = (left, right)
        if limit is None:
            found = self.fits.get(key)
            if found is None:
                if len(self.fits) >= PAIRS:
                    self.fits.clear()
                found = self.fits[key] = self._border(left, right, 1 << 40)
            return found
        return self._border(left, right, limit)

    def _border(self, left: int, right: int, limit: int) -> bool:
        """Undoes the later of both merges, again and again; a merge across that came first breaks the border."""
        while True:
            both = self.tokens.get(self.bytes_of[left] + self.bytes_of[right])
            if both is not None and both < limit:
                return False
            if left > right:
                limit = left
                left = self._halves(left)[1]
                if left == limit:
                    limit = right + 1
                    right = self._halves(right)[0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = self._halves(right)[0]
                if right + 1 == limit:
                    limit = left
                    left = self._halves(left)[1]
                    if left == limit:
                        return True

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        if data in self.tokens:
            return [self.tokens[data]]
        chars = data.decode("latin-1")
        size, out, at = len(data), [], 0
        longest = self._longest(chars)
        open_at = np.ones(size + 1, bool)
        token: int | None = longest[0]
        while token is not None:
            end = at + len(self.bytes_of[token])
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < size else None
            else:
                while True:
                    shorter = self._shorter(token)
                    if shorter is not None:
                        token = shorter
                        break
                    open_at[at] = False
                    token = out.pop()
                    at -= len(self.bytes_of[token])
        return out

    def _longest(self, chars: str) -> list[int]:
        """The longest token that begins at each place: the automaton gives all matches by their ends, longest first."""
        best = [-1] * len(chars)
        width = [0] * len(chars)
        for end, token in self.words.iter(chars):
            n = len(self.bytes_of[token])
            begin = end - n + 1
            if n > width[begin]:
                best[begin], width[begin] = token, n
        return best

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or empty one."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for p in self.cut(text):
            ids = known.get(p)
            if ids is None:
                ids = tuple(self.piece(p.encode("utf-8", "replace")))
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(p) <= 64:
                    known[p] = ids
            out.extend(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        o, blob = self.offsets, self.blob
        return b"".join([blob[o[i] : o[i + 1]] for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file: token in base 64 and id on each line."""
    with open(path, "rb") as lines:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def token_ids(text: Column, path: str) -> Column:
    """The ids of a text as an array; an empty array for a null or empty text."""

    @F.pandas_udf("array<int>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode
        for texts in batches:
            yield pd.Series([encode(t) if isinstance(t, str) else [] for t in texts], dtype=object)

    return apply(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of ids; null for null."""

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = encoder(path).decode
        for rows in batches:
            yield rows.map(decode, na_action="ignore")

    return apply(ids)


def encode_corpus(df: DataFrame, ident: str, text: str, path: str | None = None) -> DataFrame:
    """ident and ids of every row; one narrow pass without a shuffle."""
    return df.select(ident, token_ids(F.col(text), path or vocabulary_path()).alias("ids"))

