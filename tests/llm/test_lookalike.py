from __future__ import annotations

import unicodedata
from collections import Counter

import pytest

from murmuro.llm import lookalike as L

TEXT = "The quick brown fox; ÀÉÎ ñ ü 12,30 — ‘x’ fi fl"
ALPHABET = Counter(unicodedata.normalize("NFD", TEXT * 20 + "ａｂｃｅｉｎｒｓｕＡＢＣ１２３！？ ​‌‍⁠﻿­ 　  ﬁﬂаеорсухѕіһԁАВЕКМНОРСТХΑΒΕΖΗΙΚΜΝΟΡΤΥΧο‐‑️ﾏｲｸﾞマイク\t\n \x07²½"))
TABLE = frozenset(L.representatives(ALPHABET).items())


@pytest.mark.parametrize(("a", "b"), [
    ("sunrise?", "ｓｕｎｒｉｓｅ？"), ("café", "café"), ("paypal", "pаypаl"), ("no break", "no break"), ("zero​width⁠", "zerowidth"), ("soft­hyphen", "softhyphen"),
    ("a\n\n b\t c ", "a b c"), ("ﬁne ﬂow", "fine flow"), ("well-known", "well‐known"), ("ТОР", "TOP"), ("ΗΟΤ", "HOT"), ("﻿x", "x"), ("マイク", "ﾏｲｸ"), ("グ", "ｸﾞ"), ("ё", "ë"), ("a​́", "á"), ("🎙️", "🎙"), ("x　y", "x y"), ("ａ́", "á"),
])
def test_same_look(a, b):
    assert L.rewrite(a, TABLE) == L.rewrite(b, TABLE)


@pytest.mark.parametrize(("a", "b"), [("resume", "résumé"), ("Polish", "polish"), ("10", "1O"), ("x2", "x²"), ("a-b", "a–b"), ("end.", "end"), ("r̲", "r"), ("l1", "ll"), ("к", "k"), ("a b", "ab"), ("cafÃ©", "café"), ("½", "1/2"), ("rn", "m")])
def test_visibly_different(a, b):
    assert L.rewrite(a, TABLE) != L.rewrite(b, TABLE)


def test_rewriting_twice_changes_nothing_and_nulls_stay():
    for text in (TEXT, "ＡＢ​ﬁ ё マ", "", " ​ "):
        once = L.rewrite(text, TABLE)
        assert L.rewrite(once, TABLE) == once
    assert L.rewrite(None, TABLE) is None and L.rewrite(" ​⁠", TABLE) == ""


def test_representatives_follow_the_corpus():
    russian = L.representatives(Counter({"а": 50, "a": 2, "в": 9}))
    assert russian["a"] == "а" and "в" not in russian
    assert L.rewrite("a", frozenset(russian.items())) == "а"


def test_classes_are_transitive():
    forest = L.Forest()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c")):
        forest.join(a, b)
    assert len({forest.find(x) for x in "abcd"}) == 1


SCHEMA = "doc_id long, text string, form string, stored string, c string, n string, a string, b string, __id string"


def test_pairs(spark):
    texts = [(1, "one text"), (2, "one  text"), (3, "one text"), (4, "оne text"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "One text"), (10, "x" * 100_000), (11, "ｘ" * 100_000), (12, "other")]
    df = spark.createDataFrame([(*r, *["z"] * 7) for r in texts], SCHEMA).repartition(4)
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in L.pairs(df, "doc_id", "text").collect()}
    assert got == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (10, 11)}
    assert L.pairs(df.limit(0), "doc_id", "text").count() == 0


def test_pairs_against_all_pairs(spark, base):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    table = L.learn(docs, "text")
    rows = [(r["doc_id"], r["text"], L.rewrite(r["text"], table)) for r in docs.collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] and a[2] == b[2] and a[1] != b[1]}
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in L.pairs(docs, "doc_id", "text").collect()} == want


def test_canonical_column(spark):
    df = spark.createDataFrame([(1, "ａ b"), (2, None)], "doc_id long, text string")
    assert [r["form"] for r in L.canonical(df, "text", "form").orderBy("doc_id").collect()] in (["a b", None], ["ａ b", None])


WIDE = ALPHABET + Counter(unicodedata.normalize("NFD", "QԚqԛwԝvνѵgɡlӏAᎪтᴛuսnոøØđħŧıȷ̸̵̇rmhdtbioOjJ–—'’\u2018“”\"" + "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ" + TEXT))
WIDE_TABLE = frozenset(L.representatives(WIDE).items())


@pytest.mark.parametrize(("a", "b"), [
    ("Qq", "Ԛԛ"), ("wave", "ԝаνе"), ("god", "ɡоԁ"), ("l", "ӏ"), ("A", "Ꭺ"), ("т", "ᴛ"), ("sun", "ѕսո"), ("BLUE", "ꓐꓡꓴꓰ"), ("smørrebrød", "smo̸rrebro̸d"), ("Ø", "О̸"), ("smørre", "smо̸rre"),
    ("đ", "d̵"), ("đ", "ԁ̵"), ("ħŧ", "h̵t̵"), ("i", "ı̇"), ("jam", "ȷ̇am"), ("ﬁn", "fіn"), ("ﬁn", "fı̇n"),
])
def test_more_letters_and_strings(a, b):
    assert L.rewrite(a, WIDE_TABLE) == L.rewrite(b, WIDE_TABLE)


def test_no_class_holds_visibly_different_members():
    visible = ["0O", "1l", "1I", "lI", "-–", "–—", "'’", "\"“", "mr", "kк", "ıi", "oø", "dđ", "uv", "nh", "bв", "tт", "mм", "hн", "uυ", "pρ"]
    for a, b in visible:
        assert L.rewrite(a, WIDE_TABLE) != L.rewrite(b, WIDE_TABLE), (a, b)
    assert L.rewrite("modern", WIDE_TABLE) != L.rewrite("rnodern", WIDE_TABLE)
    plain = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?'\"()-–—/\\|_@#%&*+=<>[]{}~^$`"
    forms = [L.rewrite(c, WIDE_TABLE) for c in plain]
    assert len(set(forms)) == len(plain)


def test_keys_of_several_characters_and_any_choice_of_representatives():
    assert sum(len(k) > 1 for k, _ in WIDE_TABLE) >= 9
    strokes = frozenset(L.representatives(Counter({"o": 50, "\u0338": 40, "\u00f8": 3})).items())
    assert L.rewrite("\u00f8", strokes) == L.rewrite("o\u0338", strokes) == "o\u0338"
    for text in ("smo\u0338r ѕսո ﬁ", "О̸ ı̇ ԁ̵"):
        once = L.rewrite(text, WIDE_TABLE)
        assert L.rewrite(once, WIDE_TABLE) == once
    cyrillic = frozenset(L.representatives(Counter({"f": 5, "i": 5, "і": 90, "\ufb01": 2})).items())
    assert L.rewrite("\ufb01", cyrillic) == L.rewrite("fi", cyrillic) == L.rewrite("fі", cyrillic) == "fі"


def test_classes_of_texts(spark, monkeypatch):
    texts = [(1, "one text"), (2, "one  text"), (3, "one text"), (4, "оne text"), (5, None), (6, ""), (8, " "), (9, "One text"), (10, "One text")]
    df = spark.createDataFrame([(*r, *["z"] * 7) for r in texts], SCHEMA).repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in L.classes(df, "doc_id", "text").collect()}
    assert got == {1: (1, 4, 2), 2: (1, 4, 3), 3: (1, 4, 2), 4: (1, 4, 3), 9: (9, 2, 0), 10: (9, 2, 0)}
    assert L.classes(df.limit(0), "doc_id", "text").count() == 0
    monkeypatch.setattr(L, "PAIRED", 1)
    assert {(r[0], r[1]) for r in L.pairs(df, "doc_id", "text").collect()} == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
