from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from murmuro.llm import leaks as K
from murmuro.llm.catalog import p9_overlaps
from murmuro.llm.lookalike import learn

WORDS = [f"w{i}" for i in range(60)]


def brute(docs, items, table):
    out = set()
    for d, text in docs:
        ws = K.words_of(text, table)
        for i, passage in items:
            p = K.words_of(passage, table)
            n = min(K.WINDOW, len(p))
            if n and any(p[a : a + n] == ws[b : b + n] for a in range(len(p) - n + 1) for b in range(len(ws) - n + 1)):
                out.add((d, i))
    return out


def corpus(rng):
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 5, 11, 12, 13, 40])))) for i in range(25)] + [(90, None), (91, ""), (92, "?!"), (93, items_like(rng))]
    docs = []
    for d in range(120):
        words = [rng.choice(WORDS) for _ in range(rng.choice([0, 3, 30, 80]))]
        if rng.random() < 0.6:
            p = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(p) + 1)
            cut = p[a : a + rng.choice([3, 11, 12, 13, 30])]
            if cut and rng.random() < 0.3:
                cut[len(cut) // 2] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = cut
        docs.append((d, " ".join(words)))
    return docs + [(200, None), (201, ""), (202, "  ")] + docs[:5], items


def items_like(rng):
    return "Read this: " + " ".join(rng.choice(WORDS) for _ in range(20))


SCHEMA = "doc_id long, text string, item_id string, item_words string, words_in_row string, __doc string"


@pytest.mark.parametrize("bits", [1 << 16, 1 << 31])
@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, monkeypatch, seed, bits):
    monkeypatch.setattr(K, "MOST_FILTER_BITS", bits)
    if seed:
        monkeypatch.setattr(K, "PARTS", 3)
    docs, items = corpus(random.Random(seed))
    d = spark.createDataFrame([(*r, *["x"] * 4) for r in docs], SCHEMA).repartition(4)
    e = spark.createDataFrame([(*r, "x") for r in items], "item_id int, text string, doc_id string")
    table = learn(d.select("text"), "text")
    got = {(r["doc_id"], r["item_id"]) for r in K.leaked(K.find(d, e)).collect()}
    assert got == brute(docs, items, table)


def test_case_punctuation_and_look(spark):
    item = "The Fox, a quick one, jumped over my lazy dog; and left before the morning."
    docs = [(1, item.upper()), (2, item.replace("o", "о").replace(" ", " ")), (3, item.replace(",", " *-*")), (4, item.replace("jumped", "walked")), (5, "fox a quick one jumped over my lazy dog and left before"), (6, "fox a quick one jumped over my lazy dog and left")]
    got = K.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id int, text string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert {d for d, r in by.items() if r["words_in_row"] >= K.WINDOW} == {1, 2, 3, 5}
    assert by[4]["words_with_changes"] == 15 and by[4]["words_in_row"] < 12


def test_every_window_is_found_by_a_seed_in_spite_of_a_change():
    for mask in K.MASKS:
        assert len(mask) == K.WINDOW
    base = np.arange(1, K.WINDOW + 1)
    for at in range(K.WINDOW):
        changed = base.copy()
        changed[at] = 99
        hit = any(K.seed_hashes(base, m)[0] == K.seed_hashes(changed, m)[0] for m in K.MASKS)
        assert hit == any(m[at] == "0" for m in K.MASKS)


def test_tolerant_overlap():
    same = np.array([True] * 8 + [False] + [True] * 9 + [False, False, False] + [True] * 2)
    assert K.longest_run(same) == (9, 9)
    assert K.tolerant_overlap(same, 9, 9) == 18
    assert K.longest_run(np.zeros(4, bool)) == (0, 0)


def longest_tolerant(p, ws):
    """Words of the longest stretch of both that begins and ends with equal words and has one change in six at most, over all pairs of places."""
    best = 0
    for i in range(len(p)):
        for j in range(len(ws)):
            changed = 0
            for n, (a, b) in enumerate(zip(p[i:], ws[j:]), 1):
                changed += a != b
                if n == 1 and a != b:
                    break
                if a == b and changed * K.CHANGED_ONE_IN <= n:
                    best = max(best, n)
    return best


@pytest.mark.parametrize("seed", range(2))
def test_all_tolerant_overlaps_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(f"v{rng.randrange(200)}" for _ in range(rng.choice([3, 7, 8, 9, 11, 12, 20, 40])))) for i in range(20)]
    docs = []
    for d in range(150):
        words = [f"u{rng.randrange(50)}" for _ in range(20)]
        p = rng.choice(items)[1].split()
        a = rng.randrange(len(p))
        cut = p[a : a + rng.choice([7, 8, 9, 10, 11, 12, 18, 40])]
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            cut[rng.randrange(len(cut))] = "changed"
        docs.append((d, " ".join(words[:10] + cut + words[10:])))
    docs += [(900, "u1 " + " ".join(items[0][1].split()[:7]) + " u2")]
    want = {}
    for d, text in docs:
        for i, passage in items:
            if (n := longest_tolerant(passage.split(), text.split())) >= K.OVERLAP:
                want[d, i] = n
    found = K.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id int, text string"), tolerant=True)
    assert {(r["doc_id"], r["item_id"]): r["words_with_changes"] for r in found.where(f"words_with_changes >= {K.OVERLAP}").collect()} == want


def test_overlaps_of_8_to_11_words_and_of_short_items(spark, tmp_path):
    item = [f"v{i}" for i in range(30)]
    short = [f"s{i}" for i in range(10)]
    spans = {1: item[10:18], 2: item[3:14], 3: short[1:9], 4: item[5:9] + ["x"] + item[10:12] + ["x"] + item[13:17], 5: item[10:17], 6: item[:3] + ["x"] + item[4:8]}
    docs = [(d, " ".join(["a", "b", *words, "c", "d"])) for d, words in spans.items()]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id int, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = {(r["doc_id"], r["item_id"]): r["words_with_changes"] for r in p9_overlaps(spark, str(tmp_path)).collect()}
    assert got == {(1, 1): 8, (2, 1): 11, (3, 2): 8, (4, 1): 12, (6, 1): 8}


def test_every_tolerant_overlap_has_a_run():
    for n in range(K.OVERLAP, 200):
        changes = n // K.CHANGED_ONE_IN
        assert -(-(n - changes) // (changes + 1)) >= K.RUN


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    assert K.find(docs, items).count() == 0
    assert K.find(spark.createDataFrame([(1, "a b c")], docs.schema), items.limit(0)).count() == 0


def test_a_very_long_text(spark):
    passage = " ".join(f"v{i}" for i in range(14))
    docs = spark.createDataFrame([(1, "word " * 200_000 + passage)], "doc_id long, text string")
    assert K.leaked(K.find(docs, spark.createDataFrame([(1, passage)], "item_id int, text string"))).count() == 1


def test_large_and_null_ids(spark):
    big, text = (1 << 60) + 1, "a b c d"
    docs = spark.createDataFrame([(big, text), (None, text)], "doc_id long, text string")
    got = K.leaked(K.find(docs, spark.createDataFrame([(big, text), (None, text)], "item_id long, text string"))).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(a, b) for a in (big, None) for b in (big, None)}


@pytest.mark.parametrize("n", [0, 1, 900, 300_000])
def test_a_filter_holds_what_was_put_in(spark, n):
    hashes = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    df = spark.createDataFrame(pd.DataFrame({"hash": hashes.view(np.int64)}), "hash long").repartition(3)
    found, bits = K.filter_of(df, n)
    assert len(K.held(found, bits, hashes)) == n
    others = np.random.default_rng(7).integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert len(K.held(found, bits, others)) < 50


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(K, "MOST_FILTER_BITS", 1 << 16)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(900))) for i in range(60)]
    docs = [(i, "before " + " ".join(f"w{i}x{k}" for k in range(i, i + 12)) + " after") for i in range(60)]
    got = K.leaked(K.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"))).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(60)}


def test_a_passage_in_a_third_of_all_documents(spark):
    passage = " ".join(f"p{k}" for k in range(15))
    docs = spark.range(6000).selectExpr("id as doc_id", f"concat_ws(' ', 'own', id, case when id % 3 = 0 then '{passage}' else 'words' end) as text")
    items = spark.createDataFrame([(i, passage + f" item {i}") for i in range(5)], "item_id int, text string")
    assert K.leaked(K.find(docs, items)).count() == 2000 * 5
