"""Queries for training data and the SQL they are held against."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmuro.llm import bpe, leaks, lookalike, packing, quantiles, sequences, splits, splitting, turns
from murmuro.operators.compaction import shard_records
from murmuro.session import store, table

METRICS = ("entropy", "nll")


def p1_percentiles(spark: SparkSession, base: str) -> DataFrame:
    keys = ["model", "codebook"]
    return quantiles.percentiles(quantiles.sketches(table(spark, base, "model_metrics"), keys, METRICS), keys)


def _by_day(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "model_metrics").withColumn("day", F.to_date("computed_at"))
    return quantiles.sketches(rows, ["model", "codebook", "day"], METRICS)


def p1_daily(spark: SparkSession, base: str) -> DataFrame:
    return quantiles.percentiles(_by_day(spark, base), ["model", "codebook", "day"])


def p1_days_combined(spark: SparkSession, base: str) -> DataFrame:
    """The percentiles of all days from the sketches of each day."""
    days = quantiles.merged(_by_day(spark, base), ["model", "codebook", "day"])
    return quantiles.percentiles(days, ["model", "codebook"])


def p1_latest(spark: SparkSession, base: str) -> DataFrame:
    """The percentiles without rows that a later computation of their sequence replaced: those are deleted from the sketch of all."""
    rows = table(spark, base, "model_metrics")
    runs = rows.groupBy("model", "row_id", "seq_id", "computed_at").agg(F.count(F.lit(1)).alias("k"))
    replaced = runs.withColumn("last", F.max("computed_at").over(Window.partitionBy("model", "row_id", "seq_id"))).where("computed_at < last").drop("k", "last")
    old = rows.join(replaced, ["model", "row_id", "seq_id", "computed_at"], "left_semi").withColumn("w", F.lit(-1))
    keys = ["model", "codebook"]
    states = quantiles.sketches(rows, keys, METRICS).unionByName(quantiles.sketches(old, keys, METRICS, "w"))
    return quantiles.percentiles(states, keys)


def p1_error_bound(spark: SparkSession, base: str) -> DataFrame:
    """Whether each answer's rank, counted in the table, is within the stated error of the wanted one."""
    answers = store(p1_percentiles(spark, base), "answers")
    names = [f"p{p:02g}" for p in quantiles.PERCENTILES]
    long = table(spark, base, "model_metrics").select("model", "codebook", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("x"))
    fine = long.select("model", "codebook", "x.metric", "x.v").where("not isnan(v) and abs(v) < float('inf')")
    counts = []
    for n in names:
        answer = F.col(n).cast("float")
        counts += [F.sum((F.col("v") < answer).cast("long")).alias(f"{n}_less"), F.sum((F.col("v") <= answer).cast("long")).alias(f"{n}_upto")]
    ranks = fine.join(answers, ["model", "codebook", "metric"]).groupBy("model", "codebook", "metric").agg(F.count(F.lit(1)).alias("n"), *counts)
    slack = quantiles.RANK_ERROR * F.col("n") + 1
    right = F.lit(True)
    for p, n in zip(quantiles.PERCENTILES, names):
        wanted = F.col("n") * p / 100
        right = right & (F.col(f"{n}_less") <= wanted + slack) & (F.col(f"{n}_upto") >= wanted - slack)
    return ranks.select("model", "codebook", "metric", "n", right.alias("within"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return turns.turn_rows(table(spark, base, "segments")).select("source_dataset_id", "first_segment_id", "last_segment_id")


def p2_turns(spark: SparkSession, base: str) -> DataFrame:
    return turns.turn_parts(table(spark, base, "segments"))


def p2_masked(spark: SparkSession, base: str) -> DataFrame:
    """How many of the labels that the model doesn't see it finds."""
    return turns.masked(table(spark, base, "segments"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return splits.linked_recordings(table(spark, base, "segments"), table(spark, base, "shard_meta"))


def p3_splits(spark: SparkSession, base: str) -> DataFrame:
    return splits.recording_splits(table(spark, base, "segments"), table(spark, base, "shard_meta"))


def p3_records(spark: SparkSession, base: str) -> DataFrame:
    """Every record of both tables with its split."""
    of = p3_splits(spark, base).select("row_id", "split")
    segments = table(spark, base, "segments").select(F.lit("segments").alias("of"), F.col("source_dataset_id").alias("row_id"), F.lit(None).cast("string").alias("model"), F.col("segment_id").alias("number"))
    meta = shard_records(table(spark, base, "shard_meta")).select(F.lit("shard_meta").alias("of"), "row_id", "model", F.col("seq_id").alias("number"))
    return segments.unionByName(meta).join(of, "row_id", "left")


def p3_shares(spark: SparkSession, base: str) -> DataFrame:
    """How far each split's share of the records is from its target, and groups that lie in several splits."""
    of = store(p3_splits(spark, base), "splits")
    whole = of.groupBy("group_row_id").agg(F.countDistinct("split").alias("k")).agg(F.sum((F.col("k") > 1).cast("long")).alias("torn"))
    target = F.create_map(*[F.lit(x) for pair in splits.SPLITS for x in pair])
    totals = of.groupBy("split").agg(F.sum("n_records").alias("n"))
    share = F.col("n") / F.lit(of.agg(F.sum("n_records")).first()[0])
    torn = whole.first()["torn"]
    return totals.select("split", (F.abs(share - target[F.col("split")]) < 0.01).alias("near"), F.lit(torn).cast("long").alias("torn"))


def p4_windows(spark: SparkSession, base: str) -> DataFrame:
    """The window of each sequence of shard_meta, by its audio frames."""
    items = sequences.records(table(spark, base, "shard_meta"), table(spark, base, "spans"), table(spark, base, "layouts"))
    return packing.pack(items, "model", ["row_id", "seq_id"], "frames")


def p4_span_windows(spark: SparkSession, base: str) -> DataFrame:
    """The window of each sequence of spans, by the positions of all its spans."""
    return packing.pack(sequences.audio_spans(table(spark, base, "spans")), "model", ["row_id", "seq_id"], "tokens")


def p4_fill(spark: SparkSession, base: str) -> DataFrame:
    """Frames packed per model, whether all windows keep to their capacity, and whether little is unused."""
    w = p4_windows(spark, base).groupBy("model", "window").agg(F.sum("frames").alias("f"))
    fill = F.sum("f") / (F.count(F.lit(1)) * packing.WINDOW_FRAMES)
    return w.groupBy("model").agg(F.sum("f").alias("n_frames"), (F.max("f") <= packing.WINDOW_FRAMES).alias("within"), (fill > 0.9).alias("filled"))


def p4_cover(spark: SparkSession, base: str) -> DataFrame:
    """Of each sequence that was packed: its frames in all windows, and in how many windows they lie."""
    return p4_windows(spark, base).groupBy("model", "row_id", "seq_id").agg(F.sum("frames").alias("frames"), F.count(F.lit(1)).alias("n_parts"), F.count_distinct("window").alias("n_windows"))


def _record_pieces(spark: SparkSession, base: str) -> DataFrame:
    return splitting.record_pieces(*[table(spark, base, t) for t in ("shard_meta", "spans", "layouts", "segments", "pauses")])


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """The records that were cut."""
    return _record_pieces(spark, base).where("piece_no = 1").select("model", "row_id", "seq_id")


def p5_pieces(spark: SparkSession, base: str) -> DataFrame:
    return _record_pieces(spark, base)


def p5_cover(spark: SparkSession, base: str) -> DataFrame:
    """Of each record that was cut: its length, and whether its pieces cover it, keep to the limit and overlap by a second."""
    w = Window.partitionBy("model", "row_id", "seq_id").orderBy("piece_no")
    pieces = _record_pieces(spark, base).withColumn("last", F.lag("end_ms").over(w))
    sound = (F.col("end_ms") - F.col("start_ms") <= splitting.LIMIT_MS) & F.coalesce(F.col("start_ms") == F.col("last") - splitting.OVERLAP_MS, F.col("start_ms") == 0)
    return pieces.groupBy("model", "row_id", "seq_id").agg(F.max("end_ms").alias("end_ms"), F.min(sound).alias("sound"))


def p5_recording_pieces(spark: SparkSession, base: str) -> DataFrame:
    return splitting.recording_pieces(table(spark, base, "segments"), table(spark, base, "pauses"))


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, base, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Documents whose ids decode to their text, and how many ids they have in all, by language."""
    path = bpe.vocabulary_path()
    docs = table(spark, base, "documents").select("lang", "text", bpe.token_ids(F.col("text"), path).alias("ids"))
    same = (bpe.decoded(F.col("ids"), path) == F.coalesce("text", F.lit(""))).cast("long")
    return docs.groupBy(F.lower("lang").alias("lang")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(same).alias("n_same"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    found = leaks.find(table(spark, base, "documents"), table(spark, base, "eval_items"))
    return leaks.leaked(found).select("doc_id", "item_id")


def p9_overlaps(spark: SparkSession, base: str) -> DataFrame:
    """All overlaps of 8 words or more, changed words allowed."""
    found = leaks.find(table(spark, base, "documents"), table(spark, base, "eval_items"), tolerant=True)
    return found.where("words_with_changes >= 8 or words_in_row = item_words")


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return lookalike.pairs(table(spark, base, "documents"), "doc_id", "text")


def p10_classes(spark: SparkSession, base: str) -> DataFrame:
    """Each document with its class of texts that read the same, the class's size and the number of its texts that are stored differently."""
    return lookalike.classes(table(spark, base, "documents"), "doc_id", "text")


def p10_canonical(spark: SparkSession, base: str) -> DataFrame:
    """Each document's consistent text and whether it was stored so."""
    docs = lookalike.canonical(table(spark, base, "documents").select("doc_id", "text"), "text", "form")
    return docs.select("doc_id", "form", (F.col("form") == F.col("text")).alias("unchanged"))


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_daily, p1_days_combined, p1_latest, p1_error_bound, p2_found, p2_turns, p2_masked, p3_found, p3_splits, p3_records, p3_shares, p4_windows, p4_span_windows, p4_fill, p4_cover, p5_found, p5_pieces, p5_cover, p5_recording_pieces, p8_ids, p8_round_trip, p9_found, p9_overlaps, p10_found, p10_classes, p10_canonical)}

def _same_look_sql(text: str) -> str:
    """The consistent form of a text in SQL, for the characters of the test tables: full and half width, look-alikes, ligatures, blanks."""
    pairs = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {c: unicodedata.normalize("NFKC", c) for c in map(chr, range(0xFF66, 0xFF9E))}
    for group in lookalike.SAME_LOOK.replace("\n", "  ").split("  "):
        first, *others = group.split() or [""]
        if not first.isascii():
            continue  # no such letters in the test tables
        for c in others:
            pairs[c] = first
            for mark in map(chr, range(0x300, 0x330)):
                if len(one := unicodedata.normalize("NFC", c + mark)) == 1:
                    pairs[one] = unicodedata.normalize("NFC", first + mark)
    pairs = {a: b for a, b in pairs.items() if len(b) == 1}
    quoted = ["".join(x).replace("'", "''") for x in (pairs.keys(), pairs.values())]
    shown = f"regexp_replace({text}, '[\\x{{00}}-\\x{{08}}\\x{{0e}}-\\x{{1b}}\\x{{7f}}\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}\\x{{fe00}}-\\x{{fe0f}}]', '', 'g')"
    same = f"replace(replace(translate(nfc_normalize({shown}), '{quoted[0]}', '{quoted[1]}'), '\ufb01', 'fi'), '\ufb02', 'fl')"
    return f"nfc_normalize(trim(regexp_replace({same}, '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', ' ', 'g')))"


_FORM = _same_look_sql("text")
_WORDS = f"list_filter(string_split(regexp_replace(replace(lower({_FORM}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_NAME = r"[a-z]{2,}[\s_.-]*(?:no[\s_.-]*)?\d+"
_TURNS = rf"""
    WITH v AS (
      SELECT DISTINCT source_dataset_id AS r, segment_id AS g, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS e,
             regexp_replace(regexp_replace(lower({_FORM}), '[\[(<{{]?\s*\d{{1,3}}(?::\d{{2}}){{1,2}}(?:[.,]\d{{1,3}})?\s*[\])>}}]?(?:\s+-\s)?', ' ', 'g'), '\[\s*\d+(?:[.,]\d+)?\s*s\s*\]', ' ', 'g') AS t,
             lower({_same_look_sql("speaker")}) AS p
      FROM segments WHERE text IS NOT NULL AND source_dataset_id IS NOT NULL AND round(end_sec * 1000) > round(start_sec * 1000)
    ), n AS (
      SELECT *, coalesce(nullif(regexp_extract(p, '{_NAME}'), ''), regexp_extract(t, '^\s*(?:<\s*v\s|\[)?\s*({_NAME})', 1)) AS name,
             regexp_replace(regexp_replace(t, '^\s*{_NAME}\s*(?:\([^)]*\))?\s*(?:>>|:)', ' '),
               '<[^<>]*>|\[[^\[\]]*\]|\(\([^()]*\)\)|\([^()]*\)|\{{[^{{}}]*\}}|\*[^*]+\*|#[^#\s][^#]*[^#\s]#|♪[^♪]*♪', ' ', 'g') AS u FROM v
    ), w AS (
      SELECT *, regexp_extract(name, '^[a-z]+') || ':' || CAST(CAST(regexp_extract(name, '\d+$') AS BIGINT) AS VARCHAR) AS who,
             list_filter(regexp_extract_all(regexp_replace(u, '\p{{L}}{{1,2}}-(?:\s|$)', ' ', 'g'), '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: NOT regexp_full_match(x, '{turns.HESITATIONS}')) AS words FROM n
    ), o AS (
      SELECT *, CASE WHEN lag(who) OVER q IS NOT DISTINCT FROM who THEN 0 ELSE 1 END AS begins, row_number() OVER q AS k FROM w WHERE len(words) > 0 WINDOW q AS (PARTITION BY r ORDER BY s, e, g)
    ), c AS (SELECT *, sum(begins) OVER (PARTITION BY r ORDER BY k) AS turn FROM o)
    SELECT r AS source_dataset_id, arg_min(g, k) AS first_segment_id, arg_max(g, k) AS last_segment_id FROM c GROUP BY r, turn
"""
_FINITE = """
    FROM (SELECT *, unnest([{'metric': 'entropy', 'v': entropy}, {'metric': 'nll', 'v': nll}], recursive := true) FROM model_metrics)
    WHERE isfinite(v)
"""
_LINKS = r"""
    m AS (SELECT coalesce(row_id, TRY_CAST(regexp_extract(sample_key, '(\d+)[_-](\d+)', 1) AS BIGINT)) AS row_id, source_dataset_id FROM shard_meta),
    s AS (SELECT DISTINCT source_dataset_id AS r, speaker_id AS k FROM segments WHERE speaker_id <> 0),
    e AS (SELECT DISTINCT x.r AS a, y.r AS b FROM s x JOIN s y ON x.k = y.k AND x.r <> y.r
          UNION SELECT row_id, source_dataset_id FROM m WHERE row_id <> source_dataset_id
          UNION SELECT source_dataset_id, row_id FROM m WHERE row_id <> source_dataset_id),
    reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
"""
_LENGTHS = r"""
    WITH m AS (
      SELECT coalesce(nullif(lower(trim(model)), ''), lower(split_part(shard_file, '/', 2))) AS model,
             coalesce(row_id, TRY_CAST(regexp_extract(sample_key, '(\d+)[_-](\d+)', 1) AS BIGINT)) AS row_id,
             coalesce(seq_id, TRY_CAST(regexp_extract(sample_key, '(\d+)[_-](\d+)', 2) AS INT)) AS seq_id,
             max(audio_frames) FILTER (audio_frames > 0) AS f, max(frame_rate) AS r
      FROM shard_meta GROUP BY ALL
    ), s AS (
      SELECT model, row_id, seq_id, sum(n) AS n FROM (
        SELECT DISTINCT model, row_id, seq_id, span_no, span_end - span_start AS n FROM spans WHERE lower(trim(span_kind)) = 'audio') GROUP BY ALL
    ), r AS (
      SELECT m.model, m.row_id, m.seq_id, CAST(coalesce(m.f, s.n) AS BIGINT) AS frames, coalesce(m.r, l.frame_rate) AS rate
      FROM m LEFT JOIN s USING (model, row_id, seq_id) LEFT JOIN layouts l ON l.model = m.model
    )
"""
SQL = {
    "p4_fill": f"{_LENGTHS} SELECT model, CAST(sum(frames) AS BIGINT) AS n_frames, true AS within, true AS filled FROM r WHERE frames > 0 GROUP BY model",
    "p4_cover": f"{_LENGTHS} SELECT model, row_id, seq_id, CAST(frames AS BIGINT) AS frames, CAST(ceil(frames / 2048) AS BIGINT) AS n_parts, CAST(ceil(frames / 2048) AS BIGINT) AS n_windows FROM r WHERE frames > 0 AND rate > 0",
    "p5_cover": f"{_LENGTHS} SELECT model, row_id, seq_id, CAST(ceil(frames / rate * 1000) AS BIGINT) AS end_ms, true AS sound FROM r WHERE frames / rate > 30",
    "p5_found": f"{_LENGTHS} SELECT model, row_id, seq_id FROM r WHERE frames / rate > 30",
    "p3_found": f"WITH RECURSIVE {_LINKS} SELECT a AS row_id, least(a, min(b)) AS group_row_id FROM reach GROUP BY a",
    "p3_shares": "SELECT split, true AS near, CAST(0 AS BIGINT) AS torn FROM (VALUES ('train'), ('validation'), ('test')) t(split)",
    "p1_error_bound": f"SELECT model, codebook, metric, count(*) AS n, true AS within {_FINITE} GROUP BY ALL",
    "p2_found": _TURNS,
    "p9_found": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
        dg AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
        ig AS (SELECT item_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
        UNION ALL SELECT doc_id, item_id FROM d JOIN i ON len(i.w) BETWEEN 1 AND 11 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')""",
    "p10_found": f"""
        WITH f AS (SELECT doc_id, text, {_FORM} AS form FROM documents WHERE text IS NOT NULL)
        SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text WHERE a.form <> ''""",
    "p10_classes": f"""
        WITH f AS (SELECT doc_id, text, {_FORM} AS form FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS class_id, count(*) OVER (PARTITION BY form) AS n_members, count(*) OVER (PARTITION BY form) - count(*) OVER (PARTITION BY form, text) AS n_links FROM f WHERE form <> ''""",
    "p8_round_trip": "SELECT lower(lang) AS lang, count(*) AS n_docs, count(*) AS n_same FROM documents GROUP BY ALL",
}
