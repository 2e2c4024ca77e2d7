"""One stored form for texts that look the same.

Strings and code points that show the same mark are joined by one union-find into classes, transitively.
Each class is represented by its most frequent member in the corpus, and a multi-pattern automaton
rewrites every other member, longest match first. Digits and letters (1 and l, 0 and O), different dashes
and straight and curly quotes are kept apart: they are told apart by readers and mean different things. Texts are decomposed before and composed after the
rewriting, so an accent on a look-alike letter is found too.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuro.session import store

# Letters and marks of other scripts and blocks that look like the one before them.
SAME_LOOK = """
a а  c с ϲ  d ԁ  e е  g ɡ ց  h һ հ  i і  j ј ϳ  l ӏ  n ո  o о ο օ  p р  q ԛ զ  s ѕ  u ս  v ν ѵ  w ԝ  x х  y у
A А Α Ꭺ ꓮ  B В Β Ᏼ ꓐ  C С Ϲ Ꮯ ꓚ  D Ꭰ ꓓ  E Е Ε Ꭼ ꓰ  F Ϝ ꓝ  G Ԍ Ꮐ ꓖ  H Н Η Ꮋ ꓧ  I І Ι Ӏ ꓲ  J Ј Ϳ Ꭻ ꓙ  K К Κ Ꮶ ꓗ  L Ꮮ ꓡ  M М Μ Ϻ Ꮇ ꓟ  N Ν ꓠ
O О Ο Օ ꓳ  P Р Ρ Ꮲ ꓑ  Q Ԛ  R Ꭱ ꓣ  S Ѕ Տ Ꮪ ꓢ  T Т Τ Ꭲ ꓔ  U Ս ꓴ  V Ѵ Ꮩ ꓦ  W Ԝ Ꮃ ꓪ  X Х Χ ꓫ  Y Υ Ү ꓬ  Z Ζ Ꮓ ꓜ
т ᴛ  в ʙ  к ᴋ ĸ  м ᴍ  н ʜ  г ᴦ  л ᴫ  п ᴨ  я ᴙ
- ‐ ‑
"""
# Letters and the strings of several code points that look like them; the strokes are combining overlays.
SAME_STRINGS = {
    "\u00f8": ("o\u0338",), "\u00d8": ("O\u0338",),  # o with stroke
    "\u0111": ("d\u0335",), "\u0127": ("h\u0335",), "\u0167": ("t\u0335",), "\u0180": ("b\u0335",), "\u0268": ("i\u0335",),
    "i": ("\u0131\u0307", "i\u0307"), "j": ("\u0237\u0307", "j\u0307"),  # a dot on a dotless letter, or on one that has its dot
}
# Format characters (category Cf) that show a mark.
MARKED_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
# Characters of other categories that show none.
UNMARKED = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0x180B, 0x1810), *range(0xE0100, 0xE01F0)}
# Kinds of compatibility mappings that keep a letter what it is.
SAME_KINDS = ("<wide>", "<narrow>", "<font>", "<noBreak>")

_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]")


class Forest:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _blank(c: str) -> str | None:
    """"" for a character without a mark, " " for white space, None for others."""
    if c.isspace():
        return " "
    n, kind = ord(c), unicodedata.category(c)
    if n in UNMARKED or kind == "Cc" or (kind == "Cf" and n not in MARKED_FORMAT):
        return ""
    return None


def _plain(c: str) -> str | None:
    """The string that c is another form of, by Unicode's own mappings."""
    kind, _, rest = unicodedata.decomposition(c).partition(" ")
    if kind in SAME_KINDS or (kind == "<compat>" and unicodedata.category(c)[0] in "LN"):
        return unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split()))
    return None


def _letter_groups() -> list[list[str]]:
    return [group.split() for group in re.findall(r"(?<=\n)- .*|\S(?: \S)+(?=  |\n)", SAME_LOOK)]


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """What each string and code point of an alphabet is rewritten to; those that stay aren't in it.

    counts: how often each code point occurs in the decomposed corpus. One union-find joins code points and
    strings of several: those that look the same, those that Unicode maps to one another, and strings whose
    letters look the same. A class is represented by its most frequent member, ties by the lower one; a
    string of several letters is taken to be as frequent as its rarest letter, and where it represents its
    class it is spelled by its letters' representatives.
    """
    classes, blanks = Forest(), {}
    for first, *others in _letter_groups():
        for c in others:
            classes.join(first, c)
    for c in counts:
        if (blank := _blank(c)) is not None:
            if c != " ":
                blanks[c] = blank
        elif (other := _plain(c)) is not None:
            while len(other) == 1 and (further := _plain(other)) is not None:
                other = further
            if other != c:
                classes.join(c, other)
    for first, others in SAME_STRINGS.items():
        for other in others:
            classes.join(first, other)
    alike: dict[str, list[str]] = {}
    for c in list(classes.up):
        if len(c) == 1 and c in counts:
            alike.setdefault(classes.find(c), []).append(c)
    for string in [x for x in classes.up if len(x) > 1]:
        for spelling in itertools.product(*[alike.get(classes.find(c), [c]) if c in classes.up else [c] for c in string]):
            classes.join(string, "".join(spelling))
    members: dict[str, list[str]] = {}
    for x in list(classes.up):
        members.setdefault(classes.find(x), []).append(x)
    often = lambda x: min(counts.get(c, 0) for c in x)
    best = {root: min(group, key=lambda x: (-often(x), len(x), x)) for root, group in members.items()}
    letters = {c: best[root] for root, group in members.items() for c in group if len(c) == 1 and len(best[root]) == 1}
    chosen = {}
    for root, group in members.items():
        to = best[root]
        if len(to) > 1:
            to = "".join(letters.get(c, blanks.get(c, c)) for c in to)
        for x in group:
            # a string of several letters needs no key where its letters spell the same
            if x != to and (len(x) == 1 or "".join(letters.get(c, blanks.get(c, c)) for c in x) != to):
                chosen[x] = to
    return chosen | blanks


@functools.lru_cache(maxsize=4)
def _automaton(table: frozenset) -> tuple[ahocorasick.Automaton | None, bool]:
    if not table:
        return None, True
    found = ahocorasick.Automaton()
    for key, value in table:
        found.add_word(key, (len(key), value))
    found.make_automaton()
    return found, not any(key.isascii() and not key.isspace() and value for key, value in table)


def rewrite(text: str | None, table: frozenset) -> str | None:
    """The consistent form of a text; None for None."""
    if text is None:
        return None
    automaton, ascii_stays = _automaton(table)
    if ascii_stays and text.isascii():
        return " ".join(_CONTROL.sub("", text).split())
    text = unicodedata.normalize("NFD", text)
    if automaton is not None:
        parts, at = [], 0
        for end, (length, value) in automaton.iter_long(text):
            begin = end - length + 1
            if begin > at:
                parts.append(text[at:begin])
            parts.append(value)
            at = end + 1
        parts.append(text[at:])
        text = "".join(parts)
    return unicodedata.normalize("NFC", " ".join(text.split()))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            if text:
                total.update(text if text.isascii() else unicodedata.normalize("NFD", text))
    yield pd.DataFrame({"c": [ord(c) for c in total], "n": list(total.values())})


def learn(df: DataFrame, text: str) -> frozenset:
    """The rewriting table for all texts of a column.

    The driver gets one row per distinct code point; Unicode has at most 1,114,112 of them, whatever
    the size of the corpus.
    """
    counted = df.select(F.col(text).alias("text")).mapInPandas(_count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    return frozenset(representatives({chr(r["c"]): r["n"] for r in counted.collect()}).items())


def consistent(text: Column, table: frozenset) -> Column:
    """The consistent form as a column. Null stays null; a text that shows nothing becomes ''."""

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: rewrite(t, table), na_action="ignore")

    return apply(text)


def canonical(df: DataFrame, text: str, out: str, table: frozenset | None = None) -> DataFrame:
    """df with column out, the consistent form of column text. The table is learned from df if none is given."""
    return df.withColumn(out, consistent(F.col(text), learn(df, text) if table is None else table))


def same_look(df: DataFrame, ident: str, text: str) -> DataFrame:
    """One row per text that shows something: ident, form (hash of its consistent form), stored (hash of it as stored)."""
    rows = canonical(df.select(F.col(ident).alias("__id"), F.col(text).alias("__text")), "__text", "__form")
    shown = F.when(F.col("__form") != "", F.md5("__form"))  # a filter here would have the form worked out twice
    return store(rows.select(F.col("__id").alias(ident), shown.alias("form"), F.md5("__text").alias("stored")), "forms").where("form is not null")


#: Texts of one form that one task pairs with others.
PAIRED = 4096


def pairs(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Pairs of ids whose texts read the same but are stored differently; columns ident_a < ident_b.

    Only forms that are stored in more than one way are joined; copies that are stored alike make no
    pair with each other. A form of many texts is split into parts of PAIRED, each joined with all. The
    number of pairs grows with the square of a form's texts: classes is the smaller result.
    """
    rows = same_look(df, ident, text)
    several = rows.groupBy("form").agg(F.min("stored").alias("a"), F.max("stored").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("form", F.ceil(F.col("n") / PAIRED).cast("int").alias("parts"))
    kept = rows.join(several, "form")
    a = kept.select("form", F.pmod(F.xxhash64(ident), F.col("parts")).cast("int").alias("part"), F.col(ident).alias(f"{ident}_a"), F.col("stored").alias("stored_a"))
    b = kept.select("form", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col(ident).alias(f"{ident}_b"), F.col("stored").alias("stored_b"))
    differ = (F.col(f"{ident}_a") < F.col(f"{ident}_b")) & (F.col("stored_a") != F.col("stored_b"))
    return a.join(b, ["form", "part"]).where(differ).select(f"{ident}_a", f"{ident}_b")


def classes(df: DataFrame, ident: str, text: str) -> DataFrame:
    """One row per text that shows something: ident, class_id (the least id of the texts that read the same), n_members (texts of the class), n_links (those of them that are stored differently)."""
    rows = same_look(df, ident, text)
    alike = rows.groupBy("form", "stored").agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("first"))
    whole = alike.groupBy("form").agg(F.sum("n").alias("n_members"), F.min("first").alias("class_id"))
    counted = alike.join(whole, "form").select("form", "stored", "class_id", "n_members", (F.col("n_members") - F.col("n")).alias("n_links"))
    return rows.join(counted, ["form", "stored"]).select(ident, "class_id", "n_members", "n_links")
