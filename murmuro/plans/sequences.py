"""Queries on token grids, features and the training samples cut from them, and on files written and read back.

The grid of a sequence has two codebooks and a text column: the token at row p and column c is
(31 row_id + 17 seq_id + 7 p + 3 c) mod 1000. Its hidden states have two values a row, p and seq_id mod 5.
Both are made from the spans of the table, on all sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.functions import grids as G
from murmuro.operators import models as M
from murmuro.operators import samples as A
from murmuro.operators import segments as E
from murmuro.operators import spans as P
from murmuro.operators.compaction import shard_records
from murmuro.operators.intervals import valid_segments
from murmuro.operators.ordered import running_sum
from murmuro.plans.maintenance import _RECORDS as _MOVED
from murmuro.plans.measures import SQL as _MEASURES
from murmuro.plans.speech import _S
from murmuro.session import shared_dir, store, table
from murmuro.sources import audio, checkpoints, tables, tars

BOOKS, BATCH = 2, 512


def _spans(spark: SparkSession, base: str) -> DataFrame:
    return P.spans_once(table(spark, base, "spans")).where("row_id is not null and seq_id is not null and kind is not null and span_end > span_start and span_start >= 0")


def _token(p: Column, c: Column) -> Column:
    return F.pmod(31 * F.col("row_id") + 17 * F.col("seq_id") + 7 * p + 3 * c, F.lit(1000)).cast("int")


def _tokenized(spark: SparkSession, base: str) -> DataFrame:
    span = F.struct("source_dataset_id", "segment_id", F.col("span_start").alias("start"), F.col("span_end").alias("end"), "kind")
    rows = _spans(spark, base).groupBy(*A.KEYS).agg(F.array_sort(F.collect_list(span), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"])).alias("spans"), F.max("span_end").alias("n"))
    in_audio = lambda p: F.exists("spans", lambda s: (s["kind"] == "audio") & (p >= s["start"]) & (p < s["end"]))
    places = F.sequence(F.lit(0), F.col("n") - 1)
    text = lambda p: F.array(F.lit(0), F.lit(0), _token(p, F.lit(2)))
    frame = lambda p: F.array(_token(p, F.lit(0)), _token(p, F.lit(1)), F.lit(0))
    grid = F.transform(places, lambda p: F.when(in_audio(p), F.struct(frame(p).alias("t"), F.array(F.lit(True), F.lit(True), F.lit(False)).alias("m"))).otherwise(F.struct(text(p).alias("t"), F.array(F.lit(False), F.lit(False), F.lit(True)).alias("m"))))
    layout = F.struct(F.lit(BOOKS).alias("num_codebooks"), F.lit(-1).alias("text_channel"), F.array().cast("array<int>").alias("head_targets"), F.lit(None).cast("int").alias("hidden_dim"), F.lit(None).cast("array<int>").alias("logit_dims"))
    rows = rows.withColumn("g", grid)
    return rows.select(*A.KEYS, F.transform("g", lambda x: x["t"]).alias("tokens"), F.transform("g", lambda x: x["m"]).alias("mask"), "spans", layout.alias("layout"))


def _featurized(spark: SparkSession, base: str) -> DataFrame:
    """Features of the sequences whose record in shard_meta has a frame rate."""
    n = _spans(spark, base).groupBy(*A.KEYS).agg(F.max("span_end").alias("n"))
    has = shard_records(table(spark, base, "shard_meta")).where("frame_rate is not null and row_id is not null and seq_id is not null").select(*A.KEYS).distinct()
    hidden = F.transform(F.slice(F.sequence(F.lit(0), F.col("n")), F.lit(1), F.col("n") - 1), lambda p: F.array(p.cast("float"), F.pmod("seq_id", F.lit(5)).cast("float")))
    rows = has.join(n, list(A.KEYS), "left").withColumn("hiddens", hidden)
    return rows.select(*A.KEYS, "hiddens", F.array(F.transform("hiddens", lambda h: F.slice(h, F.lit(1), F.lit(1)))).alias("logits"))


def _samples(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return A.row_samples(_tokenized(spark, base), _featurized(spark, base), F.lit(12.5), semantic=(0, 995))


def row_samples(spark: SparkSession, base: str) -> DataFrame:
    """The training sample of each sequence: frames, sums of its hidden states and targets, and what its description says."""
    good, _ = _samples(spark, base)
    total = lambda rows: F.aggregate(F.flatten(rows), F.lit(0.0), lambda a, x: a + x)
    meta = lambda f: F.get_json_object("meta", f"$.{f}")
    return good.select("model", "key", "audio_frames", total("hiddens").alias("hidden_sum"), total("targets").alias("target_sum"), meta("segment_id").cast("int").alias("segment_id"), meta("hidden_dim").cast("int").alias("hidden_dim"), F.size("targets").alias("n_targets"))


def row_sample_reasons(spark: SparkSession, base: str) -> DataFrame:
    """Why sequences give no sample."""
    return _samples(spark, base)[1].groupBy("model", "reason").agg(F.count(F.lit(1)).alias("n"))


def sample_batches(spark: SparkSession, base: str) -> DataFrame:
    """The frames of a model's samples one after another in batches of 512: frames, and sums of hidden states and targets."""
    good = store(_samples(spark, base)[0].select("model", "row_id", "seq_id", "hiddens", "targets", F.col("audio_frames").cast("long").alias("n")), "samples")
    ends = running_sum(good.select("model", "row_id", "seq_id", "n"), ["model"], None, ["row_id", "seq_id"], F.col("n"), "end")
    packed = A.packed_frames(good.join(ends.select("model", "row_id", "seq_id", "end"), ["model", "row_id", "seq_id"]), ["model"], "end", BATCH)
    total = lambda rows: F.aggregate(F.flatten(rows), F.lit(0.0), lambda a, x: a + x)
    return packed.select("model", "batch_no", F.size("targets").alias("n_frames"), total("hiddens").alias("hidden_sum"), total("targets").alias("target_sum"))


def feature_layouts(spark: SparkSession, base: str) -> DataFrame:
    """Widths of hidden states and logits, by how many sequences have them."""
    f = _featurized(spark, base).select(G.feature_layout(F.col("hiddens"), F.col("logits")).alias("l"))
    return f.groupBy(F.col("l.hidden_dim").alias("hidden_dim"), F.array_join(F.col("l.logit_dims").cast("array<string>"), ",").alias("logit_dims")).agg(F.count(F.lit(1)).alias("n"))


def usable_segments(spark: SparkSession, base: str) -> DataFrame:
    return A.usable_segments(_spans(spark, base)).select("model", "row_id", "seq_id", "segment_id", "text_start", "text_end", "audio_start", "audio_end")


def span_json_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Spans as JSON and back: tokens by kind, and those that came back as another span or not at all."""
    s = _spans(spark, base).select(F.struct("source_dataset_id", "segment_id", F.col("span_start").alias("start"), F.col("span_end").alias("end"), "kind").alias("s"))
    back = s.select("s", A.span_of(A.to_text(F.col("s"))).alias("b"))
    return back.groupBy(F.col("b.kind").alias("kind")).agg(F.sum(F.col("b.end") - F.col("b.start")).alias("n_tokens"), F.sum((~F.col("s").eqNullSafe(F.col("b"))).cast("long")).alias("n_changed"))


def layout_json(spark: SparkSession, base: str) -> DataFrame:
    """Layouts as JSON and back, once with their head targets and once without, and whether they are sound."""
    l = table(spark, base, "layouts").select("model", F.struct("num_codebooks", "text_channel", "head_targets", "hidden_dim", F.lit(None).cast("array<int>").alias("logit_dims")).alias("l"))
    cases = l.select("model", F.explode(F.array(F.struct(F.lit("given").alias("targets"), F.col("l")), F.struct(F.lit("default").alias("targets"), F.col("l").withField("head_targets", F.lit(None).cast("array<int>")).alias("l")))).alias("c"))
    back = cases.select("model", "c.targets", A.layout_of(A.to_text(F.col("c.l"))).alias("b"))
    return back.select("model", "targets", F.array_join(F.col("b.head_targets").cast("array<string>"), ",").alias("head_targets"), "b.hidden_dim", A.layout_reason(F.col("b")).alias("reason"))


# ------------------------------------------------------------------ templates


def chat_grids(spark: SparkSession, base: str) -> DataFrame:
    """Segments as token grids of three layouts (text last; with a codec prefix; both in column 0): rows, sums of tokens, and how many masks are on."""
    s = valid_segments(table(spark, base, "segments")).where("text is not null").groupBy("source_dataset_id", "segment_id").agg(F.min(F.struct("start_ms", "end_ms", "text")).alias("r"))
    n = F.least(F.floor((F.col("r.end_ms") - F.col("r.start_ms")) / 80), F.lit(40)).cast("int")
    codes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda f: F.array(F.pmod(f, F.lit(10)), F.pmod(f * 3, F.lit(10)))))
    said = s.select("source_dataset_id", "segment_id", codes.alias("codes"), *[F.octet_length(t).alias(k) for k, t in (("turn", G.turn_text(F.lit(1), F.col("r.text"))), ("chat", G.chat_text(F.col("r.text"))), ("tagged", G.tagged_text(F.lit(0), F.col("r.text"))))])
    # stored: grids are nested lambdas over the codes, which would be made again for each
    said = store(said, "said")
    ids = lambda c: F.transform(F.sequence(F.lit(1), F.col(c)), lambda i: F.pmod(i, F.lit(7)))
    none = F.lit(None).cast("map<string,int>")
    prefix = G.codec_prefix(F.lit("French"), F.create_map(F.lit("french"), F.lit(5)), F.lit(None).cast("string"), none, {"think": 1, "nothink": 2, "think_bos": 3, "think_eos": 4, "pad": 6, "bos": 7})
    main = F.concat(ids("tagged"), F.transform("codes", lambda c: F.get(c, F.lit(0)) + 100))
    with_zeros = F.transform(main, lambda t: F.concat(F.array(t), F.array_repeat(F.lit(0), BOOKS)))
    kinds = {"last": G.text_last(ids("turn"), F.col("codes"), BOOKS), "prefix": G.text_last(ids("chat"), F.col("codes"), BOOKS, prefix, 9), "dual": F.struct(with_zeros.alias("tokens"), G.dual_mask(main, BOOKS, 100, 110).alias("mask"))}
    rows = [said.select("source_dataset_id", "segment_id", F.lit(k).alias("layout"), g.alias("g")) for k, g in kinds.items()]
    flat = rows[0].unionByName(rows[1]).unionByName(rows[2])
    count = lambda m: F.aggregate(F.flatten(m), F.lit(0), lambda a, x: a + x.cast("int"))
    return flat.groupBy("source_dataset_id", "layout").agg(F.sum(F.size("g.tokens")).alias("n_rows"), F.sum(F.aggregate(F.flatten("g.tokens"), F.lit(0), lambda a, x: a + x)).alias("token_sum"), F.sum(count(F.col("g.mask"))).alias("n_on"))


def segment_codes(spark: SparkSession, base: str) -> DataFrame:
    """Every segment with its frames of its channel's codes, none where raw_rows knows no length of the recording or no such channel, or ends it before."""
    v = valid_segments(table(spark, base, "segments"))
    once = v.groupBy("source_dataset_id", "segment_id").agg(F.min(F.struct("start_ms", "end_ms", "source_audio_channel_id")).alias("r")).select("source_dataset_id", "segment_id", F.col("r.source_audio_channel_id").alias("channel"), (F.col("r.start_ms") / 1000).alias("start_sec"), (F.col("r.end_ms") / 1000).alias("end_sec"))
    bounds = E.frame_bounds(once, F.lit(12.5), F.lit(1 << 30))
    raw = E.recordings_once(table(spark, base, "raw_rows")).where("duration_sec > 0 and duration_sec < double('infinity') and num_channels > 0")
    frames = F.transform(F.sequence(F.lit(1), F.ceil(F.col("duration_sec") * 12.5).cast("int")), lambda f: F.pmod(f - 1, F.lit(1000)))
    codes = raw.select(F.col("row_id").alias("source_dataset_id"), F.explode(F.sequence(F.lit(0), F.col("num_channels") - 1)).alias("channel"), frames.alias("codes"))
    out = A.codes_of_segments(bounds, codes, "source_dataset_id", "channel")
    return out.select("source_dataset_id", "segment_id", F.coalesce(F.size("codes"), F.lit(-1)).alias("n_codes"), F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"))


# ------------------------------------------------------------------ written and read back


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored_sequences(spark: SparkSession, base: str) -> DataFrame:
    """Sequences written with the caches that some have, and read again: frames and caches by model."""
    lengths = P.sequence_lengths(_spans(spark, base)).withColumns({"layout": F.lit(BOOKS), "kv_cache": F.when(F.pmod("seq_id", F.lit(3)) == 0, F.array(F.col("n_tokens").cast("double")))})
    folder = _folder(spark, "featurized")
    has = tables.write_features(lengths, folder, ["layout"])
    back = tables.load_sequences(spark, f"{folder}/features", f"{folder}/caches" if has else None)
    return back.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("n_tokens"), F.count("kv_cache").alias("n_caches"), F.sum(F.get("kv_cache", F.lit(0))).alias("cache_sum"))


def unmatched_sequences(spark: SparkSession, base: str) -> DataFrame:
    """Sequences that only the spans or only the metrics have."""
    return tables.unmatched(_spans(spark, base), table(spark, base, "model_metrics")).groupBy("model", "side").agg(F.count(F.lit(1)).alias("n"))


def codebook_sink(spark: SparkSession, base: str) -> DataFrame:
    """Codec frames of every vector written and read again."""
    frame = lambda at: F.transform(F.slice("embedding", at, 4), lambda x: F.floor(x * 10).cast("int"))
    codes = table(spark, base, "embeddings").select(F.col("vec_id").alias("row"), F.lit(0).alias("channel"), F.array(*[frame(k * 4 + 1) for k in range(16)]).alias("codes"), F.lit(24_000).alias("sample_rate"), F.lit(12.5).alias("frame_rate"))
    folder = _folder(spark, "codebooks")
    tables.write_codebooks(codes, folder)
    back = spark.read.parquet(folder)
    return back.select("row", "num_codebooks", F.size("codes").alias("n_frames"), F.aggregate(F.flatten("codes"), F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"))


def metrics_sink(spark: SparkSession, base: str) -> DataFrame:
    """Metrics written with their summary and read again: rows by model, from both."""
    m = table(spark, base, "model_metrics")
    summary = m.groupBy("model", "row_id").agg(F.count(F.lit(1)).alias("n"))
    folder = _folder(spark, "metrics")
    tables.write_metrics(m, summary, folder)
    frames, rows = tables.read_metrics(spark, folder)
    return frames.groupBy("model").agg(F.count(F.lit(1)).alias("n_frames")).join(rows.groupBy("model").agg(F.sum("n").alias("n_summed"), F.count(F.lit(1)).alias("n_rows")), "model")


def evaluation_report(spark: SparkSession, base: str) -> DataFrame:
    """An evaluation written as one JSON report and read again."""
    from murmuro.operators import metrics

    m = metrics.latest_cells(table(spark, base, "model_metrics")).join(table(spark, base, "layouts").select("model", "frame_rate"), "model")
    report = metrics.residual_eval(m, F.col("frame_rate")).agg(F.sum("n_frames").alias("frames"), F.max(F.round("avg_nll", 6)).alias("worst_avg_nll"))
    path = f"{_folder(spark, 'report')}.json"
    tables.write_report(report, path)
    return spark.read.json(path, multiLine=True)


def failure_log(spark: SparkSession, base: str) -> DataFrame:
    """Segments that don't fit their recording, logged as lines of JSON and read again."""
    checked = E.check_segments(table(spark, base, "segments"), table(spark, base, "raw_rows"))
    _, bad = tables.split_valid(checked, F.col("reason"))
    folder = _folder(spark, "failures")
    tables.write_failures(bad.select(F.lit("ingest").alias("stage"), "source_dataset_id", "segment_id", "reason"), folder)
    return spark.read.json(folder).groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("n"))


def wave_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """A hundred vectors as sound: decoded from their codes, written to a wave file, read and encoded again; whether the codes are the same."""
    backend = M.ToyBackend()
    frames = F.array(*[F.transform(F.slice("embedding", k * 4 + 1, 4), lambda x: F.pmod(F.floor(x * 100), F.lit(16)).cast("int")) for k in range(16)])
    clips = table(spark, base, "embeddings").groupBy(F.format_string("%08d", F.floor(F.col("vec_id") / 100)).alias("name")).agg(F.array_sort(F.collect_list(F.struct("vec_id", frames.alias("f")))).alias("v"))
    clips = store(clips.select("name", F.flatten(F.transform("v", lambda x: x["f"])).alias("codes")), "codes")
    folder = _folder(spark, "waves")
    audio.write_wav(clips.select("name", F.lit(backend.sample_rate).alias("sample_rate"), M.decoded(F.col("codes"), backend).alias("samples")), folder).collect()
    back = audio.read_wav(spark, folder).select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("name"), "sample_rate", M.encoded(F.col("samples"), backend).alias("back"))
    return clips.join(back, "name", "left").select("name", "sample_rate", F.size("codes").alias("n_frames"), (F.col("codes") == F.col("back")).alias("same"))


def tensor_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Where the rows of a projection of ten heads of ten dimensions go, by the checkpoint's renaming and permutation, for every vector as a row."""
    rows = table(spark, base, "embeddings").select(F.lit("decoder.layers.0.attn.q_proj.weight").alias("key"), F.col("vec_id").alias("row"), F.col("embedding").alias("vector"))
    out = checkpoints.permuted(checkpoints.renamed(rows, checkpoints.key_names(spark)), F.col("key").contains("q_proj"), F.lit(10))
    return out.select("key", "row", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


def prompts_read(spark: SparkSession, base: str) -> DataFrame:
    """Prompts written as lines of JSON, with blank lines between, and read again."""
    docs = table(spark, base, "documents").where("genre = 'prompt' and text is not null")
    folder = _folder(spark, "prompts")
    docs.select(F.explode(F.array(F.to_json(F.struct("text")), F.lit("  "))).alias("line")).write.text(folder)
    return tables.read_prompts(spark, folder).groupBy(F.length("text").alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))


def shard_frames(spark: SparkSession, base: str) -> DataFrame:
    """Samples of the table written to tar shards and read again: frames and targets of all."""
    good = _samples(spark, base)[0].where("model = 'miso'").select("key", "hiddens", "targets", "meta", "row_id", "seq_id")
    placed = running_sum(good, [], None, ["row_id", "seq_id"], F.lit(1).cast("long"), "n").withColumn("place", F.col("n") - 1)
    folder = _folder(spark, "shards")
    index = store(tars.write_tars(placed, folder, "all", 1000), "index")
    back = tars.read_tars(spark, folder).groupBy("shard").agg(F.count(F.lit(1)).alias("n_read"), F.sum(F.size("targets")).alias("n_frames"))
    return index.join(back, "shard").select("shard", "num_samples", "total_frames", "n_read", "n_frames")


def scripts_spoken(spark: SparkSession, base: str) -> DataFrame:
    """Texts of dialogues as scripts of two speakers, spoken by the backend without weights: turns, frames, and turns that stayed too fast or too slow."""
    docs = table(spark, base, "documents").where("genre = 'dialogue' and text is not null and trim(text) <> ''")
    lines = docs.select(F.col("doc_id").alias("script_id"), F.posexplode(F.split("text", r"[.!?\n]+\s*")).alias("turn", "text")).where("trim(text) <> ''").withColumn("speaker", F.pmod("turn", F.lit(2)))
    out = M.rendered(lines, M.ToyBackend())
    return out.groupBy("script_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("n_frames").alias("n_frames"), F.sum(F.col("collapsed").cast("long")).alias("n_collapsed"), F.max("context_turns").alias("context_turns"))


QUERIES = {f.__name__: f for f in (
    row_samples, row_sample_reasons, sample_batches, feature_layouts, usable_segments, span_json_round_trip, layout_json, chat_grids, segment_codes, stored_sequences, unmatched_sequences, codebook_sink,
    metrics_sink, evaluation_report, failure_log, wave_round_trip, tensor_round_trip, prompts_read, shard_frames, scripts_spoken,
)}

_RECORDS = _MOVED.replace("shard_file\n", "shard_file, frame_rate\n")
_T = f"""
  t AS (SELECT model, row_id, seq_id, max(span_end) AS n, count(*) FILTER (kind = 'audio') AS k, min(span_start) FILTER (kind = 'audio') AS a, min(span_end) FILTER (kind = 'audio') AS b, min(segment_id) FILTER (kind = 'audio') AS segment_id
        FROM s WHERE row_id IS NOT NULL AND seq_id IS NOT NULL AND kind IN ('text', 'audio', 'special') AND span_end > span_start AND span_start >= 0 GROUP BY ALL),
  f AS (SELECT DISTINCT m.model, m.row_id, m.seq_id FROM ({_RECORDS}) m WHERE m.frame_rate IS NOT NULL AND m.row_id IS NOT NULL AND m.seq_id IS NOT NULL),
  x AS (SELECT *, unnest(range(a, b)) AS p FROM t WHERE k = 1 AND a >= 1),
  y AS (SELECT model, row_id, seq_id, sum(p - 1 + seq_id % 5) AS hidden_sum, sum((31 * row_id + 17 * seq_id + 7 * p) % 1000 + (31 * row_id + 17 * seq_id + 7 * p + 3) % 1000) AS target_sum, max((31 * row_id + 17 * seq_id + 7 * p) % 1000) AS top FROM x GROUP BY ALL),
  o AS (SELECT coalesce(t.model, f.model) AS model, coalesce(t.row_id, f.row_id) AS row_id, coalesce(t.seq_id, f.seq_id) AS seq_id, a, b, t.segment_id, hidden_sum, target_sum,
          CASE WHEN t.model IS NULL THEN 'not tokenized' WHEN f.model IS NULL THEN 'not featurized' WHEN k = 0 THEN 'no audio' WHEN k > 1 THEN 'several audio' WHEN a < 1 THEN 'first' WHEN top > 995 THEN 'semantic' ELSE 'ok' END AS reason
        FROM t FULL JOIN f USING (model, row_id, seq_id) LEFT JOIN y USING (model, row_id, seq_id))
"""
_ONE = """v AS (SELECT source_dataset_id, segment_id, arg_min(source_audio_channel_id, (s, e)) AS channel, min((s, e))[1] AS start_ms, min((s, e))[2] AS end_ms FROM (
  SELECT *, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS e FROM segments WHERE round(end_sec * 1000) > round(start_sec * 1000)) GROUP BY ALL)"""
_CHECKED = """
  r AS (SELECT row_id, arg_max(num_channels, added_at) AS c, arg_max(duration_sec, added_at) AS d, arg_max(sample_rate, added_at) AS k FROM (SELECT DISTINCT * FROM raw_rows) GROUP BY 1)
"""
SQL = {
    "row_samples": f"""WITH {_S}, {_T} SELECT model, printf('%08d_%05d', row_id, seq_id) AS key, CAST(b - a AS INT) AS audio_frames, CAST(hidden_sum AS DOUBLE) AS hidden_sum, CAST(target_sum AS DOUBLE) AS target_sum, segment_id, 2 AS hidden_dim, CAST(b - a AS INT) AS n_targets
        FROM o WHERE reason = 'ok'""",
    "row_sample_reasons": f"WITH {_S}, {_T} SELECT model, reason, count(*) AS n FROM o WHERE reason <> 'ok' GROUP BY ALL",
    "sample_batches": f"""WITH {_S}, {_T}, g AS (SELECT o.model, o.row_id, o.seq_id, p, row_number() OVER (PARTITION BY o.model ORDER BY o.row_id, o.seq_id, p) - 1 AS place FROM o JOIN x USING (model, row_id, seq_id) WHERE reason = 'ok')
        SELECT model, place // 512 AS batch_no, CAST(count(*) AS INT) AS n_frames, CAST(sum(p - 1 + seq_id % 5) AS DOUBLE) AS hidden_sum, CAST(sum((31 * row_id + 17 * seq_id + 7 * p) % 1000 + (31 * row_id + 17 * seq_id + 7 * p + 3) % 1000) AS DOUBLE) AS target_sum FROM g GROUP BY ALL""",
    "feature_layouts": f"WITH {_S}, {_T} SELECT CASE WHEN n > 1 THEN 2 END AS hidden_dim, CASE WHEN n > 1 THEN '1' ELSE '' END AS logit_dims, count(*) AS n FROM f JOIN t USING (model, row_id, seq_id) GROUP BY ALL",
    "usable_segments": f"""WITH {_S}, g AS (SELECT * FROM s WHERE row_id IS NOT NULL AND seq_id IS NOT NULL AND segment_id IS NOT NULL AND span_end > span_start AND span_start >= 0)
        SELECT t.model, t.row_id, t.seq_id, t.segment_id, t.span_start AS text_start, t.span_end AS text_end, a.span_start AS audio_start, a.span_end AS audio_end
        FROM (SELECT * FROM g WHERE kind = 'text' QUALIFY row_number() OVER (PARTITION BY model, row_id, seq_id, source_dataset_id, segment_id ORDER BY span_start DESC) = 1) t
        JOIN (SELECT * FROM g WHERE kind = 'audio' QUALIFY row_number() OVER (PARTITION BY model, row_id, seq_id, source_dataset_id, segment_id ORDER BY span_start DESC) = 1) a
          ON t.model = a.model AND t.row_id = a.row_id AND t.seq_id = a.seq_id AND t.segment_id = a.segment_id AND t.source_dataset_id IS NOT DISTINCT FROM a.source_dataset_id""",
    "span_json_round_trip": f"""WITH {_S} SELECT kind, CAST(sum(span_end - span_start) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_changed FROM s
        WHERE row_id IS NOT NULL AND seq_id IS NOT NULL AND kind IN ('text', 'audio', 'special') AND span_end > span_start AND span_start >= 0 GROUP BY ALL""",
    "layout_json": """WITH c AS (SELECT model, num_codebooks AS k, hidden_dim, head_targets AS given, list_filter(range(num_codebooks + 1), lambda x: x <> (text_channel + num_codebooks + 1) % (num_codebooks + 1)) AS own FROM layouts)
        SELECT model, 'given' AS targets, array_to_string(given, ',') AS head_targets, hidden_dim, 'ok' AS reason FROM c UNION ALL SELECT model, 'default', array_to_string(own, ','), hidden_dim, CASE WHEN len(own) = k THEN 'ok' ELSE 'heads' END FROM c""",
    "chat_grids": r"""WITH o AS (SELECT source_dataset_id, min((s, e, text)) AS m FROM (SELECT *, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS e FROM segments WHERE text IS NOT NULL AND round(end_sec * 1000) > round(start_sec * 1000)) GROUP BY source_dataset_id, segment_id),
        u AS (SELECT source_dataset_id, least((m[2] - m[1]) // 80, 40) AS c, octet_length(encode('[1] ' || regexp_replace(m[3], '^[\s\x0b\x{85}\p{Z}]+', ''))) AS n1, octet_length(encode(m[3])) + 55 AS n2,
                octet_length(encode(m[3])) + CASE WHEN contains(m[3], '<|speaker:') THEN 0 ELSE 13 END AS n3 FROM o),
        w AS (SELECT *, list_sum(list_transform(range(1, c + 1), lambda f: f % 10 + 3 * f % 10)) AS pair, list_sum(list_transform(range(1, c + 1), lambda f: f % 10 + 100)) AS one FROM u),
        x AS (SELECT source_dataset_id, 'last' AS layout, n1 AS n, n1 + CASE WHEN c > 0 THEN c + 1 ELSE 0 END AS r, CASE WHEN c > 0 THEN pair ELSE 0 END AS t, n1 + CASE WHEN c > 0 THEN 2 * c + 2 ELSE 0 END AS k FROM w
          UNION ALL SELECT source_dataset_id, 'prefix', n2, n2 + CASE WHEN c > 0 THEN c + 7 ELSE 0 END, CASE WHEN c > 0 THEN pair + 35 ELSE 0 END, n2 + CASE WHEN c > 0 THEN 2 * c + 8 ELSE 0 END FROM w
          UNION ALL SELECT source_dataset_id, 'dual', CASE WHEN c > 0 THEN n3 END, CASE WHEN c > 0 THEN n3 + c END, CASE WHEN c > 0 THEN one END, CASE WHEN c > 0 THEN n3 + 3 * c END FROM w)
        SELECT source_dataset_id, layout, CAST(sum(r) AS BIGINT) AS n_rows, CAST(sum(t + n // 7 * 21 + (n % 7) * (n % 7 + 1) // 2) AS BIGINT) AS token_sum, CAST(sum(k) AS BIGINT) AS n_on FROM x GROUP BY ALL""".replace("\\\\", "\\"),
    "segment_codes": f"""WITH {_ONE}, b AS (SELECT *, CAST(floor(start_ms / 1000 * 12.5) AS BIGINT) AS fs, CAST(ceil(end_ms / 1000 * 12.5) AS BIGINT) AS fe FROM v), {_CHECKED},
        q AS (SELECT b.source_dataset_id, segment_id, fs, CASE WHEN d > 0 AND isfinite(d) AND channel < c THEN least(fe, CAST(ceil(d * 12.5) AS BIGINT)) END AS e FROM b LEFT JOIN r ON b.source_dataset_id = r.row_id)
        SELECT source_dataset_id, segment_id, CAST(CASE WHEN e > fs THEN e - fs ELSE -1 END AS INT) AS n_codes, CASE WHEN e > fs THEN CAST(list_sum(list_transform(range(fs, e), lambda f: f % 1000)) AS BIGINT) END AS code_sum FROM q""",
    "stored_sequences": f"""WITH {_S}, n AS (SELECT model, row_id, seq_id, max(span_end) AS n FROM s WHERE row_id IS NOT NULL AND seq_id IS NOT NULL AND kind IN ('text', 'audio', 'special') AND span_end > span_start AND span_start >= 0 GROUP BY ALL)
        SELECT model, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) FILTER (seq_id % 3 = 0) AS n_caches, CAST(sum(n) FILTER (seq_id % 3 = 0) AS DOUBLE) AS cache_sum FROM n GROUP BY ALL""",
    "unmatched_sequences": f"""WITH {_S}, a AS (SELECT DISTINCT model, row_id, seq_id FROM s WHERE row_id IS NOT NULL AND seq_id IS NOT NULL AND kind IN ('text', 'audio', 'special') AND span_end > span_start AND span_start >= 0), b AS (SELECT DISTINCT model, row_id, seq_id FROM model_metrics)
        SELECT model, 'tokenized' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY ALL UNION ALL SELECT model, 'featurized', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) GROUP BY ALL""",
    "codebook_sink": "SELECT vec_id AS row, 4 AS num_codebooks, 16 AS n_frames, CAST(list_sum(list_transform(embedding, lambda x: CAST(floor(x * 10::FLOAT) AS BIGINT))) AS BIGINT) AS code_sum FROM embeddings",
    "metrics_sink": "SELECT model, count(*) AS n_frames, count(*) AS n_summed, count(DISTINCT (row_id, 1)) AS n_rows FROM model_metrics GROUP BY 1",
    "evaluation_report": f"SELECT CAST(sum(n_frames) AS BIGINT) AS frames, max(avg_nll) AS worst_avg_nll FROM ({_MEASURES['residual_eval']})",
    "failure_log": f"""WITH {_CHECKED} SELECT 'ingest' AS stage, * FROM (
        SELECT CASE WHEN row_id IS NULL THEN 'no recording' WHEN start_sec IS NULL OR end_sec IS NULL OR isnan(start_sec) OR isnan(end_sec) THEN 'no time' WHEN end_sec <= start_sec THEN 'reversed'
               WHEN source_audio_channel_id >= c THEN 'channel' WHEN start_sec < 0 THEN 'negative' WHEN NOT isnan(d) AND end_sec > d + 1.0::DOUBLE / k THEN 'late' ELSE 'ok' END AS reason, count(*) AS n
        FROM segments LEFT JOIN r ON source_dataset_id = row_id GROUP BY 1) WHERE reason <> 'ok'""",
    "wave_round_trip": "SELECT printf('%08d', vec_id // 100) AS name, 8000 AS sample_rate, CAST(count(*) * 16 AS INT) AS n_frames, true AS same FROM embeddings GROUP BY vec_id // 100",
    "tensor_round_trip": "SELECT 'decoder.layers.0.self_attn.q_proj.weight' AS key, vec_id // 10 * 10 + vec_id % 10 % 2 * 5 + vec_id % 10 // 2 AS row, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings",
    "prompts_read": "SELECT length(text) AS n_chars, count(*) AS n FROM documents WHERE genre = 'prompt' AND text IS NOT NULL GROUP BY 1",
    "shard_frames": f"""WITH {_S}, {_T}, g AS (SELECT b - a AS n, row_number() OVER (ORDER BY row_id, seq_id) - 1 AS place FROM o WHERE reason = 'ok' AND model = 'miso')
        SELECT printf('all_%05d.tar', place // 1000) AS shard, count(*) AS num_samples, CAST(sum(n) AS BIGINT) AS total_frames, count(*) AS n_read, CAST(sum(n) AS BIGINT) AS n_frames FROM g GROUP BY place // 1000""",
}
