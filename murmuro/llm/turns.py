"""Clean, ordered speaker turns from raw transcript segments.

Each segment is cleaned first: timestamps, labels, sound notes and hesitations are taken out of its
text, and its labels are read from the label column and from the text. The segments of a recording are
then cut into turns by a semi-Markov conditional model. A turn is a run of segments by one speaker; its
score is the sum of
 - the log-likelihood of its segments' labels given its speaker (a label may be wrong, as often as labels in
   column and text are seen to disagree, so it can be outvoted),
 - for each border inside it, the log-probability that the turn goes on, and for the border at its end that
   it ends, given how many segments it has so far, the pause, the share of words that go on, the words of the
   segment after the border and the length of the one before.
These probabilities are a logistic model fitted on all neighbouring labelled segments, from their counts
per combination of features. A segment's speaker is one of its own labels or of the nearest labelled
segments before and after it; a recording without labels has two nameless ones. A dynamic program over
whole turns finds the segmentation with the highest score. Turns of more than LONGEST segments go on or
end alike, so its state is (speaker, segments so far), at most 4 times LONGEST numbers.

Segments are sorted over the whole cluster, so a recording may lie in many partitions. Three scans: one
sums up labels, edges and counts; one works out, for recordings that cross partitions only, the best
score from each state at a partition's start to each at its end; the driver joins these in order and decides
the states at the borders of partitions; the last scan fills in the turns between. Only summaries, a few
rows a partition, reach the driver.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from murmuro.llm.lookalike import representatives, rewrite
from murmuro.operators.intervals import valid_segments
from murmuro.session import cut, store

# ------------------------------------------------------------------ cleaning

# Hesitations of English, French, Spanish and German, as patterns of whole words.
HESITATIONS = r"u+m+|u+h+|u+h+m+|e+r+m*|h+m+|m{2,}|e+u+h+|h+e+u+|hum|e+h+m*|em|ä+h+m*|ö+h+m*"
# Hesitations that are words of a language, with frequent words of that language.
WORDS_TOO = {
    "er": "der die das und ist nicht mit von für wir sie ich",
    "um": "der die das und ist nicht mit von für wir sie ich",
    "hum": "the and of was with we they she",
}
_SPACE = r"[\s\-_.]*"
LABEL = rf"[^\W\d_]{{2,}}{_SPACE}(?:no\b{_SPACE})?\d+"
_CLOCK = r"\d{1,3}(?::\d{2}){1,2}(?:[.,]\d{1,3})?"
TIMES = re.compile(rf"[\[(<{{]\s*{_CLOCK}\s*[\])>}}]|(?<![\w:]){_CLOCK}(?![\w:])(?:\s+-(?=\s))?|\[\s*\d+(?:[.,]\d+)?\s*s\s*\]", re.I)
VOICE = re.compile(r"<\s*v(?:\.[^\s>]*)?\s+([^<>]*)>", re.I)
HEAD = re.compile(rf"\s*(?:\[\s*({LABEL})[^\]\[]*\]|({LABEL})(?:\s*\([^()]*\))?\s*(?::(?!\d)|>>))", re.I)
# each runs to its own closing mark and holds none of its opening ones, so texts of any length take linear time
NOTES = re.compile(r"<[^<>]*>|\[[^\[\]]*\]|\(\([^()]*\)\)|\([^()]*\)|\{[^{}]*\}|\*(?=\S)[^*\n]+(?<=\S)\*|#(?=\S)[^#\n]+(?<=\S)#|♪[^♪\n]*♪|[♪♫]", re.I)
BROKEN = re.compile(r"(?<![\w'’-])#?(?:([^\W\d_]+)-\s+(?=\1)|[^\W\d_]{1,2}-(?=\s|$)|[^\W\d_]+-\s*$)", re.I)
_FILLER = re.compile(rf"(?<![\w'’-])(?:{HESITATIONS})(?![\w'’-])(?:\s*(?:\.\.\.|…|,))?", re.I)
_NAMED = re.compile(rf"([^\W\d_]{{2,}}){_SPACE}(?:no\b{_SPACE})?(\d+)", re.I)
_BEFORE_NAME = re.compile(r"^\W*(?:(?:speaker|spk|sprecher|locuteur|hablante)\b[\s=:]*)+(?=[^\W\d_]{2,}\W*(?:no\b\W*)?\d)", re.I)
_MARKS = frozenset("<[({*#♪♫")
_LOOSE = re.compile(r"\s+([,.!?;:…])")
_EDGES = re.compile(r"^[\s,.;:…\-–—]+(?=\S)|\s+[\-–—#]+$")
_SPOKEN = re.compile(r"[^\W_]")
_TABLE: dict[str, frozenset] = {}


def _even(text: str) -> str:
    """Full-width and compatibility forms as plain ones, without characters that show nothing; no change of look-alike letters."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text)
    return text if text.isascii() else text.translate(_unmarked())


@functools.cache
def _unmarked() -> dict[int, None]:
    """Format characters and the variation selector of emoji."""
    return dict.fromkeys([0xFE0F, *(c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf")])


def _letters(text: str) -> str:
    """With look-alike letters as the usual ones."""
    if text.isascii():
        return text
    if "t" not in _TABLE:
        _TABLE["t"] = frozenset(representatives({chr(c): 1 if c > 127 else 2 for c in range(33, 0x600)}).items())
    return rewrite(text, _TABLE["t"]) or ""


def speaker_of(label: str | None) -> str | None:
    """letters:number of a label, whatever stands around them; None where it names no speaker."""
    if not label:
        return None
    plain = _BEFORE_NAME.sub("", _letters(_even(label)).strip())
    found = _NAMED.search(plain)
    return f"{found[1].lower()}:{int(found[2])}" if found else None


_LANGUAGES = {word: frozenset(frequent.split()) for word, frequent in WORDS_TOO.items()}
_LETTERS = re.compile(r"[^\W\d_]+")


def clean(text: str | None) -> tuple[str | None, str]:
    """(label found in a text or None, the spoken text); the spoken text is '' where no word is left."""
    if not text:
        return None, ""
    text = _even(text)
    if ":" in text or "]" in text:
        text = TIMES.sub(" ", text)
    label = None
    if "<" in text:
        if voice := VOICE.search(text):
            label = speaker_of(voice[1])
        text = VOICE.sub(" ", text)
    while (":" in text or ">>" in text or "]" in text) and (found := HEAD.match(text if text.isascii() else _same_length(text))):
        label = label or speaker_of(found[1] or found[2])
        text = text[found.end() :]
    if not _MARKS.isdisjoint(text):
        text = NOTES.sub(" ", text)
    if "-" in text:
        text = BROKEN.sub("", text)
    words: frozenset[str] | None = None

    def filler(found: re.Match) -> str:
        nonlocal words
        if (frequent := _LANGUAGES.get(found[0].rstrip(" .,…\t\n").lower())) is None:
            return " "
        if words is None:
            words = frozenset(_LETTERS.findall(text.lower()))
        return " " if words.isdisjoint(frequent) else found[0]

    text = " ".join(_FILLER.sub(filler, text).split())
    text = _LOOSE.sub(r"\1", text)
    text = _EDGES.sub("", text)
    return label, text if _SPOKEN.search(text) else ""


def _same_length(text: str) -> str:
    even = _letters(text)
    return even if len(even) == len(text) else text


# ------------------------------------------------------------------ the model

PAUSES = (-200, 0, 100, 250, 500, 1000, 2000)
SHARED = (0.0, 0.1, 0.3)
WORDS = (3, 9)
LENGTHS = (1000, 4000)
#: Numbers of segments of a turn that the model tells apart; longer turns are like those of so many.
LONGEST = 8
SIZES = (len(PAUSES) + 1, len(SHARED) + 1, len(WORDS) + 1, len(LENGTHS) + 1)
CELLS = math.prod(SIZES)
#: Labels that are taken to be right before any are counted, and wrong ones; the weight of small coefficients.
TRUSTED, DOUBTED, RIDGE = 1_000_000, 1, 1.0
_WORDS = re.compile(r"[^\W_]+")
#: Speakers of recordings without labels.
NAMELESS = ("", "\x00")


def cell_of(pause_ms: int, before: frozenset, after: frozenset, n_words: int = 0, length_ms: int = 0) -> int:
    """The cell of a border: the classes of its pause, of the share of words that go on, of the words of the segment after it, and of the length of the one before."""
    shared = len(before & after) / max(1, min(len(before), len(after)))
    cell = bisect.bisect_right(PAUSES, pause_ms) * SIZES[1] + bisect.bisect_left(SHARED, shared)
    return (cell * SIZES[2] + bisect.bisect_right(WORDS, n_words)) * SIZES[3] + bisect.bisect_right(LENGTHS, length_ms)


def border_scores(same: np.ndarray, changed: np.ndarray) -> tuple[list[list[float]], list[list[float]]]:
    """(stay, change): for each cell and number of segments so far less one, the log-probability that a turn goes on and that it ends.

    same, changed: counts (CELLS, LONGEST). A logistic model with one coefficient per class of each feature,
    fitted by Newton's method with a ridge of RIDGE.
    """
    grid = np.indices((*SIZES, LONGEST)).reshape(5, -1)
    x = np.concatenate([np.ones((1, grid.shape[1])), *[(g == c)[None] for g, n in zip(grid, (*SIZES, LONGEST)) for c in range(1, n)]]).astype(float)
    n, k = (same + changed).ravel().astype(float), changed.ravel().astype(float)
    seen = n > 0
    part, n, k = x[:, seen], n[seen], k[seen]
    w, penalty = np.zeros(len(x)), np.full(len(x), RIDGE)
    for _ in range(50 if len(n) else 0):
        p = 1 / (1 + np.exp(-np.clip(w @ part, -30, 30)))
        step = np.linalg.solve((part * (n * p * (1 - p))) @ part.T + np.diag(penalty), part @ (k - n * p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    odds = np.round(np.clip(w @ x, -30, 30), 9).reshape(CELLS, LONGEST)
    return (-np.logaddexp(0, odds)).tolist(), (-np.logaddexp(0, -odds)).tolist()


def label_scores(agree: int, disagree: int) -> tuple[float, float]:
    """The log-likelihood of a right label and of a wrong one, both less the right one's: a right label changes no score."""
    wrong = (disagree + DOUBTED) / (agree + disagree + TRUSTED)
    return 0.0, math.log(wrong / 2) - math.log1p(-wrong)


@dataclass(frozen=True)
class Model:
    stay: list[list[float]]
    change: list[list[float]]
    right: float
    wrong: float


@dataclass(slots=True)
class Item:
    recording: int
    segment: int
    start: int
    end: int
    labels: tuple[str, ...]
    words: frozenset
    cell: int = -1
    near: str = ""  # of those who may speak it the first


def candidates(labels: tuple[str, ...], before: str | None, after: str | None) -> tuple[str, ...]:
    """Who may speak a segment: its own labels, that of the nearest labelled one before and after; the nameless if there are none."""
    found = dict.fromkeys([*labels, *(x for x in (before, after) if x is not None)])
    return tuple(found) or NAMELESS


_NONE = [-math.inf] * LONGEST


def begun(who: tuple[str, ...], labels: tuple[str, ...], model: Model) -> dict[str, list[float]]:
    """The scores of the states after a recording's first segment."""
    out = {}
    for y in who:
        out[y] = [sum(model.right if y == l else model.wrong for l in labels), *_NONE[1:]]
    return out


def stepped(old: dict[str, list[float]], who: tuple[str, ...], labels: tuple[str, ...], cell: int, model: Model) -> tuple[dict[str, list[float]], dict[str, tuple[str, int] | None]]:
    """The scores of the states after the next segment, and the state from which each speaker takes over."""
    stay, change = model.stay[cell], model.change[cell]
    ends = {}
    for s, o in old.items():
        e = list(map(add, o, change))
        top = max(e)
        ends[s] = (top, LONGEST - 1 - e[::-1].index(top))
    new, source = {}, {}
    for y in who:
        evidence = 0.0
        for l in labels:
            evidence += model.right if y == l else model.wrong
        best, at = -math.inf, None
        for s, (top, k) in ends.items():
            if s != y and top > best:
                best, at = top, (s, k)
        o = old.get(y)
        if o is None:
            new[y] = [best + evidence, *_NONE[1:]]
        else:
            on = list(map(add, o, stay))
            if evidence:
                on = [x + evidence for x in on]
            last = on.pop()
            if last >= on[-1]:
                on[-1] = last
            new[y] = [best + evidence, *on]
        source[y] = at
    return new, source


def stays_longest(old: list[float], cell: int, model: Model) -> bool:
    """Whether the best way to LONGEST segments is from LONGEST, not from one fewer."""
    return old[-1] + model.stay[cell][-1] >= old[-2] + model.stay[cell][-2]


# ------------------------------------------------------------------ partitions

_COLUMNS = ("rec", "seg", "start", "end", "label", "found", "words")
_TEXTS, _NUMBERS = pa.list_(pa.string()), pa.list_(pa.int64())
_EDGE = pa.struct({"start": pa.int64(), "end": pa.int64(), "n_words": pa.int32(), "words": pa.list_(pa.int32())})
_SUMMARY = pa.schema({
    "part": pa.int32(), "first_rec": pa.int64(), "last_rec": pa.int64(), "first": _EDGE, "last": _EDGE, "first_label": pa.string(), "last_label": pa.string(), "own": _TEXTS, "before_last": pa.string(),
    "lead": pa.list_(_NUMBERS), "lead_ends": pa.bool_(), "run": pa.int64(), "run_speaker": pa.string(), "lead_speaker": pa.string(), "cells": _NUMBERS, "same": _NUMBERS, "changed": _NUMBERS, "agree": pa.int64(), "disagree": pa.int64(),
})
_TRANSFER = pa.schema({"part": pa.int32(), "kind": pa.string(), "who": _TEXTS, "scores": pa.list_(pa.list_(pa.float64()))})
_PIECES = pa.schema({"rec": pa.int64(), "speaker": pa.string(), "joins": pa.bool_(), "part": pa.int32(), "k": pa.int64(), "first_seg": pa.int32(), "last_seg": pa.int32(), "start": pa.int64(), "end": pa.int64(), "n": pa.int64()})
_ASSIGNED = pa.schema({"rec": pa.int64(), "seg": pa.int32(), "speaker": pa.string(), "part": pa.int32(), "k": pa.int64(), "at": pa.int64(), "joins": pa.bool_(), "start": pa.int64(), "end": pa.int64(), "near": pa.string()})


def items_of(batches: Iterator[pa.RecordBatch], edge: Item | None) -> Iterator[Item]:
    """The segments in order, each with the cell of the border before it (-1 at a recording's start)."""
    last = edge
    for batch in batches:
        for rec, seg, start, end, label, found, words in zip(*[batch.column(c).to_pylist() for c in _COLUMNS]):
            labels = (label,) if found is None or found == label else (found,) if label is None else (label, found)
            at = Item(rec, seg, start, end, () if labels == (None,) else labels, frozenset(words))
            if last is not None and last.recording == rec:
                at.cell = cell_of(start - last.end, last.words, at.words, len(words), last.end - last.start)
            yield at
            last = at


def _opened(batches: Iterator[pa.RecordBatch]) -> tuple[int, Iterator[pa.RecordBatch]] | None:
    head = next((b for b in batches if b.num_rows), None)
    if head is None:
        return None
    return head.column("part")[0].as_py(), itertools.chain([head], batches)


def _row(values: tuple, kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(kinds.names, values))], kinds)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a partition tells the others: its edges, the labels nearest to them, and counts for the model.

    A border counts where both segments have a label, by the number of segments that the left one's run of
    equal labels has. A run that began before the partition has a length that isn't known here, so its first
    LONGEST borders are passed on.
    """
    found = _opened(batches)
    if found is None:
        return
    part, rows = found
    counts: dict[tuple[int, int], list[int]] = {}
    first = last = None
    first_label = last_label = before_last = speaker = None
    lead: list[list[int]] = []
    run, leading, agree, disagree = 0, True, 0, 0  # run: segments of the last run, 0 if its start isn't known

    def told(items: Iterator[Item]) -> Iterator[Item]:
        nonlocal agree, disagree
        for batch in rows:
            both = pa.compute.equal(batch.column("label"), batch.column("found"))
            yes = pa.compute.sum(both).as_py() or 0
            agree, disagree = agree + yes, disagree + len(both) - both.null_count - yes
            yield batch

    lead_speaker = None
    for at in items_of(told(rows), None):
        who = at.labels[0] if at.labels else None
        fresh = last is not None and last.recording != at.recording
        if fresh:
            last_label = None
        before_last = last_label
        if first is None:
            first, lead_speaker, speaker = at, who, who
            leading = who is not None
        else:
            if fresh or who is None or speaker is None:
                leading = False
                run = 1 if fresh and who is not None else 0
            else:
                changed = who != speaker
                if leading:
                    if len(lead) < LONGEST:
                        lead.append([at.cell, int(changed)])
                    else:
                        counts.setdefault((at.cell, LONGEST - 1), [0, 0])[changed] += 1
                elif run:
                    counts.setdefault((at.cell, min(run, LONGEST) - 1), [0, 0])[changed] += 1
                if changed:
                    run, leading = 1, False
                else:
                    run = run + 1 if run else 0
            speaker = who
        if who is not None:
            last_label = who
            if first_label is None and at.recording == first.recording:
                first_label = who
        last = at
    keys = sorted(counts)
    edge = lambda x: {"start": x.start, "end": x.end, "n_words": len(x.words), "words": sorted(x.words)}
    yield _row((
        part, first.recording, last.recording, edge(first), edge(last), first_label, last_label, list(last.labels), before_last, lead, not leading, run if not leading else len(lead) + 1, speaker, lead_speaker,
        [c * LONGEST + k for c, k in keys], [counts[x][0] for x in keys], [counts[x][1] for x in keys], agree, disagree,
    ), _SUMMARY)


@dataclass(frozen=True)
class Context:
    """What lies around a partition: the segment before it, the labels nearest to it, and the states at its ends where a recording goes on."""

    edge: Item | None  # the last segment before it, of the same recording
    enter: tuple[str, ...]  # who may speak that
    before: str | None
    after: str | None
    goes_on: bool
    enter_state: tuple[str, int] | None = None
    exit_state: tuple[str, int] | None = None


def contexts(rows: list) -> dict[int, Context]:
    """Combines the summaries of partitions in their order."""
    rows = sorted(rows, key=lambda r: r["part"])
    n = len(rows)
    joins = [i > 0 and rows[i]["first_rec"] == rows[i - 1]["last_rec"] for i in range(n)] + [False]
    whole = [r["first_rec"] == r["last_rec"] for r in rows]
    before: list[str | None] = [None] * (n + 1)  # the last label before partition i in the recording it goes on with
    for i in range(1, n + 1):
        if joins[i]:
            r = rows[i - 1]
            before[i] = r["last_label"] if r["last_label"] is not None else before[i - 1] if whole[i - 1] and joins[i - 1] else None
    after: list[str | None] = [None] * (n + 1)  # the first label from partition i on in the recording it goes on with
    for i in range(n - 1, 0, -1):
        if joins[i]:
            after[i] = rows[i]["first_label"] if rows[i]["first_label"] is not None else after[i + 1] if whole[i] and joins[i + 1] else None
    out = {}
    for i, r in enumerate(rows):
        edge, enter = None, ()
        if joins[i]:
            p = rows[i - 1]
            edge = Item(p["last_rec"], 0, p["last"]["start"], p["last"]["end"], (), frozenset(p["last"]["words"]))
            earlier = p["before_last"] if p["before_last"] is not None else before[i - 1] if whole[i - 1] and joins[i - 1] else None
            enter = candidates(tuple(p["own"]), earlier, after[i])
        out[r["part"]] = Context(edge, enter, before[i] if joins[i] else None, after[i + 1] if joins[i + 1] else None, joins[i + 1])
    return out


def fitted(rows: list) -> Model:
    """The model from the counts of all partitions, and from the borders between and at the beginning of partitions."""
    rows = sorted(rows, key=lambda r: r["part"])
    same, changed = np.zeros(CELLS * LONGEST, np.int64), np.zeros(CELLS * LONGEST, np.int64)
    for r in rows:
        np.add.at(same, r["cells"], r["same"])
        np.add.at(changed, r["cells"], r["changed"])
    run, speaker, last = 0, None, None
    for r in rows:
        known = 0  # segments, so far, of the run that the partition begins with
        if last is None or r["first_rec"] != last["last_rec"]:
            known = 1 if r["lead_speaker"] is not None else 0
        elif speaker is not None and r["lead_speaker"] is not None and run:
            cell = cell_of(r["first"]["start"] - last["last"]["end"], frozenset(last["last"]["words"]), frozenset(r["first"]["words"]), r["first"]["n_words"], last["last"]["end"] - last["last"]["start"])
            is_change = r["lead_speaker"] != speaker
            (changed if is_change else same)[cell * LONGEST + min(run, LONGEST) - 1] += 1
            known = 1 if is_change else run + 1
        elif speaker is not None and r["lead_speaker"] is not None and r["lead_speaker"] != speaker:
            known = 1
        for i, (cell, is_change) in enumerate(r["lead"] if known else []):
            (changed if is_change else same)[cell * LONGEST + min(known + i, LONGEST) - 1] += 1
        run = r["run"] if r["lead_ends"] else known + r["run"] - 1 if known else 0
        speaker, last = r["run_speaker"], r
    return Model(*border_scores(same.reshape(CELLS, LONGEST), changed.reshape(CELLS, LONGEST)), *label_scores(sum(r["agree"] for r in rows), sum(r["disagree"] for r in rows)))


def with_candidates(items: Iterator[Item], here: Context) -> Iterator[tuple[Item, tuple[str, ...]]]:
    """Each segment with who may speak it. Held back are those after the last labelled one, whose next label isn't known."""
    held: list[Item] = []
    before = here.before

    def let_go(after: str | None) -> Iterator[tuple[Item, tuple[str, ...]]]:
        nonlocal before
        for x in held:
            who = candidates(x.labels, before, after)
            x.near = who[0]
            yield x, who
            if x.labels:
                before = x.labels[0]
        held.clear()

    recording = here.edge.recording if here.edge else None
    for at in items:
        if at.recording != recording:
            yield from let_go(None)
            if recording is not None or here.edge is None:
                before = None
            recording = at.recording
        if at.labels:
            yield from let_go(at.labels[0])
        held.append(at)
    yield from let_go(here.after if here.goes_on else None)


def states(who: tuple[str, ...]) -> list[tuple[str, int]]:
    return [(y, k) for y in who for k in range(LONGEST)]


#: Segments after which it is looked whether all beginnings have come to the same, but for a constant.
LOOK = 32


class Beginnings:
    """The scores of states from several beginnings at once; beginnings that differ by a constant from then on are kept as one."""

    def __init__(self, starts: list[dict[str, list[float]]]) -> None:
        self.starts, self.shift = starts, [0.0] * len(starts)
        self.of = list(range(len(starts)))

    def step(self, who: tuple[str, ...], labels: tuple[str, ...], cell: int, model: Model) -> None:
        self.starts = [stepped(v, who, labels, cell, model)[0] for v in self.starts]

    def merge(self) -> None:
        flat = [[x for y in v for x in v[y]] for v in self.starts]
        kept: list[int] = []
        to: list[tuple[int, float]] = []
        for i, row in enumerate(flat):
            top = max(row)
            for at, j in enumerate(kept):
                d = top - max(flat[j]) if top > -math.inf else 0.0
                if all((a == b) if a == -math.inf or b == -math.inf else abs(a - b - d) < 1e-9 for a, b in zip(row, flat[j])):
                    to.append((at, d))
                    break
            else:
                to.append((len(kept), 0.0))
                kept.append(i)
        self.shift = [s + to[o][1] for s, o in zip(self.shift, self.of)]
        self.of = [to[o][0] for o in self.of]
        self.starts = [self.starts[i] for i in kept]

    def scores(self, who: tuple[str, ...]) -> list[list[float]]:
        """A row per beginning, a column per state."""
        return [[x + s for y in who for x in self.starts[o].get(y, _NONE)] for o, s in zip(self.of, self.shift)]


def _transfers(around: dict[int, Context], model: Model, ends: dict[int, tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For recordings that cross partitions: head, the best scores from each state at a partition's start to the states at its end, or to the recording's; tail, those of a recording that begins here and goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _opened(batches)
        if found is None:
            return
        part, rows = found
        here, (first_rec, last_rec) = around[part], ends[part]
        paths: dict[str, tuple[Beginnings, tuple[str, ...]]] = {}
        at_head: Beginnings | None = None
        if here.edge is not None:
            at_head = Beginnings([{y: [0.0 if (y, k) == s else -math.inf for k in range(LONGEST)] for y in here.enter} for s in states(here.enter)])
        n = 0
        for at, who in with_candidates(items_of(rows, here.edge), here):
            n += 1
            if at.recording == first_rec and at_head is not None:
                at_head.step(who, at.labels, at.cell, model)
                paths["head"] = (at_head, who)
            elif at.recording == last_rec:
                if at.cell < 0:
                    paths["tail"] = (Beginnings([begun(who, at.labels, model)]), who)
                else:
                    paths["tail"][0].step(who, at.labels, at.cell, model)
                    paths["tail"] = (paths["tail"][0], who)
            if n % LOOK == 0 and "head" in paths and len(at_head.starts) > 1:
                at_head.merge()
        for kind, (b, who) in paths.items():
            if kind == "head" or here.goes_on:
                yield _row((part, kind, list(who), b.scores(who)), _TRANSFER)

    return run


def _longest(scores: np.ndarray) -> int:
    """The state with the highest score; of equal ones that with the longer turn."""
    near = np.flatnonzero(scores >= scores.max() - 1e-9)
    return int(near[(near % LONGEST).argmax()])


def decided(rows: list, around: dict[int, Context]) -> dict[int, Context]:
    """The contexts with the states at the borders of partitions that the best segmentations pass."""
    found = {(r["part"], r["kind"]): r for r in rows}
    parts = sorted(around)
    entered: dict[int, tuple[str, int]] = {}
    chain: list[tuple[int, np.ndarray, np.ndarray]] = []  # partition, scores of the states at its start, and from them to those at its end
    scores: np.ndarray | None = None

    def ordered(row, who: tuple[str, ...]) -> np.ndarray:
        """The scores of a row with columns in the order of who's states."""
        at = {s: j for j, s in enumerate(states(tuple(row["who"])))}
        return np.array(row["scores"])[:, [at[s] for s in states(who)]]

    for i, p in enumerate(parts):
        here = around[p]
        through = here.goes_on and (p, "tail") not in found
        if here.edge is not None:
            if through:
                table = ordered(found[p, "head"], around[parts[i + 1]].enter)
                chain.append((p, scores, table))
                scores = (scores[:, None] + table).max(axis=0)
            else:
                at = _longest(scores + np.array(found[p, "head"]["scores"]).max(axis=1))
                entered[p] = states(here.enter)[at]
                for q, came, table in reversed(chain):
                    at = _longest(came + table[:, at])
                    entered[q] = states(around[q].enter)[at]
                chain = []
        if here.goes_on and not through:
            scores = ordered(found[p, "tail"], around[parts[i + 1]].enter)[0]
    return {p: replace(around[p], enter_state=entered.get(p), exit_state=entered.get(parts[i + 1]) if around[p].goes_on else None) for i, p in enumerate(parts)}


#: Segments of a recording after which those are given out whose turn no later segment can change.
SETTLE = 4096


class Path:
    """The best turns of one recording's segments in a partition, as they come."""

    def __init__(self, model: Model, enter: tuple[str, int] | None) -> None:
        self.model, self.items, self.sources = model, [], []
        self.scores = {enter[0]: [0.0 if k == enter[1] else -math.inf for k in range(LONGEST)]} if enter else None

    def add(self, at: Item, who: tuple[str, ...]) -> None:
        self.items.append(at)
        if self.scores is None:
            self.scores = begun(who, at.labels, self.model)
            self.sources.append(({}, ()))
        else:
            old = self.scores
            self.scores, source = stepped(old, who, at.labels, at.cell, self.model)
            self.sources.append((source, [y for y in who if y in old and stays_longest(old[y], at.cell, self.model)]))

    def _back(self, i: int, state: tuple[str, int]) -> tuple[str, int] | None:
        y, k = state
        source, long = self.sources[i]
        if k == 0:
            return source.get(y)
        return (y, k) if k == LONGEST - 1 and y in long else (y, k - 1)

    def settled(self) -> Iterator[tuple[Item, tuple[str, int]]]:
        """Segments through whose states all best ways go; they are given out once."""
        live = {(y, k) for y, o in self.scores.items() for k, x in enumerate(o) if x > -math.inf}
        i = len(self.items) - 1
        while len(live) > 1 and i > 0:
            live = {self._back(i, s) for s in live}
            i -= 1
        if len(live) == 1 and i < len(self.items) - 1:
            yield from self._way(i, next(iter(live)))
            self.items, self.sources = self.items[i + 1 :], self.sources[i + 1 :]

    def _way(self, i: int, state: tuple[str, int]) -> Iterator[tuple[Item, tuple[str, int]]]:
        found = []
        while i >= 0:
            found.append((self.items[i], state))
            state = self._back(i, state) if i else state
            i -= 1
        return reversed(found)

    def rest(self, exit_state: tuple[str, int] | None) -> Iterator[tuple[Item, tuple[str, int]]]:
        if not self.items:
            return iter(())
        if exit_state is None:
            exit_state = max(((y, k) for y, o in self.scores.items() for k in range(LONGEST)), key=lambda s: (self.scores[s[0]][s[1]], s[1]))  # of equal ones the longer turn
        return self._way(len(self.items) - 1, exit_state)


def _decode(around: dict[int, Context], model: Model, each: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns as far as they lie in a partition, or with each their segments."""
    kinds = _ASSIGNED if each else _PIECES

    def placed(rows: Iterator[pa.RecordBatch], here: Context) -> Iterator[tuple[Item, tuple[str, int]]]:
        path = Path(model, here.enter_state)
        recording = here.edge.recording if here.edge else None
        for at, who in with_candidates(items_of(rows, here.edge), here):
            if at.recording != recording:
                if recording is not None:
                    yield from path.rest(None)
                path, recording = Path(model, None), at.recording
            path.add(at, who)
            if len(path.items) >= SETTLE:
                yield from path.settled()
        yield from path.rest(here.exit_state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _opened(batches)
        if opened is None:
            return
        part, rows = opened
        here = around[part]
        out: list[list] = []
        recording, k, joins, n = None, 0, False, 0

        def given() -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

        for at, (speaker, place) in placed(rows, here):
            fresh = place == 0 or recording is None or at.recording != recording
            if fresh:
                joins = place > 0
                k = k + 1 if at.recording == recording else 0
                recording = at.recording
            if each:
                out.append([at.recording, at.segment, speaker.strip("\x00"), part, k, n, joins, at.start, at.end, at.near])
                n += 1
            elif fresh:
                if len(out) >= 5000:
                    yield given()
                    out = []
                out.append([at.recording, speaker.strip("\x00"), joins, part, k, at.segment, at.segment, at.start, at.end, 1])
            else:
                last = out[-1]
                last[6], last[8], last[9] = at.segment, max(last[8], at.end), last[9] + 1
            if each and len(out) >= 5000:
                yield given()
                out = []
        if out:
            yield given()

    return run


# ------------------------------------------------------------------ over tables


def cleaned(segments: DataFrame) -> DataFrame:
    """The valid segments, each once: rec, seg, start, end (ms), label (letters:number of the label column, or null), found (of the text), words (hashes of the spoken text's words), text ('' without spoken words).

    Of rows with the same recording and segment number that differ, the one with the least start, end,
    text and label counts. A filter on the text belongs after this has been written; before, it would
    have texts cleaned twice.
    """
    kept = valid_segments(segments).where("source_dataset_id is not null and segment_id is not null and text is not null")
    once = kept.groupBy("source_dataset_id", "segment_id").agg(F.min(F.struct("start_ms", "end_ms", "text", F.coalesce("speaker", F.lit("")).alias("speaker"))).alias("r"))

    @F.arrow_udf("struct<label string, found string, words array<int>, text string>")
    def read(labels: pa.Array, texts: pa.Array) -> pa.Array:
        named, founds, spokens, words, ends = [], [], [], [], [0]
        known: dict[str, str | None] = {}
        crc = zlib.crc32
        for label, text in zip(labels.to_pylist(), texts.to_pylist()):
            if label not in known:
                if len(known) > 100_000:
                    known.clear()
                known[label] = speaker_of(label)
            found, spoken = clean(text)
            words += [crc(w.encode()) for w in set(_WORDS.findall(spoken.lower()))]
            ends.append(len(words))
            named.append(known[label])
            founds.append(found)
            spokens.append(spoken)
        hashes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(words, np.uint32).view(np.int32)))
        return pa.StructArray.from_arrays([pa.array(named, pa.string()), pa.array(founds, pa.string()), hashes, pa.array(spokens, pa.string())], ["label", "found", "words", "text"])

    return (
        once.select(F.col("source_dataset_id").cast("long").alias("rec"), F.col("segment_id").cast("int").alias("seg"), F.col("r.start_ms").alias("start"), F.col("r.end_ms").alias("end"), read("r.speaker", "r.text").alias("c"))
        .select("rec", "seg", "start", "end", "c.label", "c.found", "c.words", "c.text")
    )


def decoded(rows: DataFrame, each: bool = False) -> DataFrame:
    """The turns of cleaned segments as pieces of partitions (or with each their segments), stored. Rows without spoken words have to be left out before."""
    spark, order = rows.sparkSession, ["rec", "start", "end", "seg"]
    ordered = cut(rows.select(*_COLUMNS).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    told = ordered.mapInArrow(_summarise, from_arrow_schema(_SUMMARY)).collect()
    model, around = fitted(told), contexts(told)
    crossing = [(c.edge.recording,) for c in around.values() if c.edge is not None]
    if crossing:
        ends = {r["part"]: (r["first_rec"], r["last_rec"]) for r in told}
        theirs = ordered.join(F.broadcast(spark.createDataFrame(sorted(set(crossing)), "rec long")), "rec", "left_semi").select(*_COLUMNS, "part")
        around = decided(theirs.mapInArrow(_transfers(around, model, ends), from_arrow_schema(_TRANSFER)).collect(), around)
    return store(ordered.mapInArrow(_decode(around, model, each), from_arrow_schema(_ASSIGNED if each else _PIECES)), "pieces")


def turn_rows(segments: DataFrame) -> DataFrame:
    """One row per turn, without its text: source_dataset_id, turn_no (from 0, in order), speaker (letters and number), first_segment_id, last_segment_id, start_sec, end_sec, n_segments.

    Segments are taken in the order of start, end and number, all channels together. A segment without
    any label goes to a speaker near it; a recording without labels has nameless speakers, who change where
    a change is likelier than none. Null and empty texts and segments without valid times are left out.
    """
    return _joined(decoded(store(cleaned(segments), "cleaned").where("text <> ''")))


#: Segments whose texts are joined in one value of turn_parts.
PART_SEGMENTS = 4096


def turn_parts(segments: DataFrame) -> DataFrame:
    """The rows of turn_rows with their text, a turn of more than PART_SEGMENTS segments in several rows: adds part_no (from 0) and text."""
    rows = store(cleaned(segments), "cleaned").where("text <> ''")
    own = decoded(rows, each=True)
    pieces = own.groupBy("rec", "part", "k").agg(
        F.first("speaker").alias("speaker"), F.max("joins").alias("joins"), F.min_by("seg", "at").alias("first_seg"), F.max_by("seg", "at").alias("last_seg"), F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"),
    )
    numbered = store(_numbered(store(pieces, "pieces")), "numbered")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("rec", "turn_no").orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = numbered.withColumn("n_before", before).select("rec", "part", "k", "turn_no", "n_before")
    first = own.groupBy("rec", "part", "k").agg(F.min("at").alias("first_at"))
    at = own.select("rec", "seg", "part", "k", "at").join(starts.join(first, ["rec", "part", "k"]), ["rec", "part", "k"])
    texts = at.join(rows.select("rec", "seg", "text"), ["rec", "seg"]).withColumn("part_no", F.floor((F.col("n_before") + F.col("at") - F.col("first_at")) / PART_SEGMENTS))
    joined = texts.groupBy(F.col("rec").alias("source_dataset_id"), "turn_no", "part_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "text"))), lambda x: x["text"]), " ").alias("text"))
    return _turns(numbered).join(joined, ["source_dataset_id", "turn_no"])


def turns(segments: DataFrame) -> DataFrame:
    """The rows of turn_rows, each with its whole text in one value. Where turns may hold more than a value can, turn_parts is the way."""
    parts = turn_parts(segments)
    keys = [c for c in parts.columns if c not in ("part_no", "text")]
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "text"))), lambda x: x["text"]), " ")
    return parts.groupBy(*keys).agg(whole.alias("text"))


def speakers_of(rows: DataFrame) -> DataFrame:
    """The speaker of each of cleaned's rows with spoken words: rec, seg, speaker (letters:number, '' for nameless), near (its own label, else the nearest before it, else after it)."""
    return decoded(rows.where("text <> ''"), each=True).select("rec", "seg", "speaker", "near")


def masked(segments: DataFrame, one_in: int = 5) -> DataFrame:
    """How well labels are found that the model doesn't see: those of one segment in one_in, chosen by a hash, are hidden.

    Columns: n_segments, n_hidden, n_right (hidden ones that were given their speaker), n_by_last (those of
    the nearest visible label's speaker, the one before first, as a plain rule would say).
    """
    rows = store(cleaned(segments), "cleaned").where("text <> ''")
    hidden = F.pmod(F.xxhash64("rec", "seg"), F.lit(one_in)) == 0
    seen = rows.withColumns({c: F.when(~hidden, F.col(c)) for c in ("label", "found")})
    truth = rows.select("rec", "seg", F.coalesce("label", "found").alias("truth"), hidden.alias("hidden"))
    judged = truth.join(speakers_of(seen), ["rec", "seg"])
    asked = F.col("hidden") & F.col("truth").isNotNull()
    return judged.agg(F.count(F.lit(1)).alias("n_segments"), F.count_if(asked).alias("n_hidden"), F.count_if(asked & (F.col("speaker") == F.col("truth"))).alias("n_right"), F.count_if(asked & (F.col("near") == F.col("truth"))).alias("n_by_last"))


def _numbered(pieces: DataFrame) -> DataFrame:
    """pieces with turn_no: a partition's first piece belongs to the last turn before it if it goes on with that.

    Only the first recording of a partition continues one, so one row per partition tells how many of
    its turns came before; no task sees a whole recording.
    """
    ends = pieces.groupBy("part").agg(F.min_by(F.struct("rec", "joins"), F.struct("rec", "k")).alias("first"), F.max_by(F.struct("rec", "k"), F.struct("rec", "k")).alias("last"))
    rows, state = [], None
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        offset = 0
        if state is not None and state[0] == r["first"]["rec"]:
            offset = state[1] - (1 if r["first"]["joins"] else 0)
        rows.append((r["part"], r["first"]["rec"], offset))
        state = (r["last"]["rec"], r["last"]["k"] + 1 + (offset if r["last"]["rec"] == r["first"]["rec"] else 0))
    before = pieces.sparkSession.createDataFrame(rows, "part int, rec long, before long")
    return pieces.join(F.broadcast(before), ["part", "rec"], "left").withColumn("turn_no", F.col("k") + F.coalesce("before", F.lit(0)))


def _turns(numbered: DataFrame) -> DataFrame:
    at = F.struct("part", "k")
    return numbered.groupBy(F.col("rec").alias("source_dataset_id"), "turn_no").agg(
        F.regexp_replace(F.max("speaker"), ":", "").alias("speaker"), F.min_by("first_seg", at).alias("first_segment_id"), F.max_by("last_seg", at).alias("last_segment_id"),
        (F.min("start") / 1000).alias("start_sec"), (F.max("end") / 1000).alias("end_sec"), F.sum("n").alias("n_segments"),
    )


def _joined(pieces: DataFrame) -> DataFrame:
    return _turns(_numbered(pieces))
