"""Queries on segments, recordings and their spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.functions import scalars as S
from murmuro.operators import dialogue as D
from murmuro.operators import segments as G
from murmuro.operators import spans as P
from murmuro.operators.compaction import shard_records
from murmuro.operators.intervals import valid_segments
from murmuro.operators.ordered import greedy_pack, islands, numbered, trimmed_context, with_recent
from murmuro.session import store, table
from murmuro.sources.tables import missing, selected

#: Segment numbers in a bucket in which order is kept; the longest recordings are many.
SPAN_SEQUENCES = 64


def _valid(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    """Each valid segment once, with its length and the given columns."""
    v = valid_segments(table(spark, base, "segments"))
    row = F.struct("start_ms", "end_ms", *columns)
    once = v.groupBy("source_dataset_id", "segment_id").agg(F.min(row).alias("r")).select("source_dataset_id", "segment_id", "r.*")
    return once.withColumn("length_ms", F.col("end_ms") - F.col("start_ms"))


def segment_checks(spark: SparkSession, base: str) -> DataFrame:
    """How many stored segments fail which check against their recording."""
    checked = G.check_segments(table(spark, base, "segments"), table(spark, base, "raw_rows"))
    return checked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def transcript_json_parse(spark: SparkSession, base: str) -> DataFrame:
    """Segments written as one JSON transcript per event and parsed again, with its defaults."""
    props = table(spark, base, "events").select("event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    item = F.to_json(F.struct(F.struct(F.lit(0).alias("start"), F.col("value").alias("end"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("channel")).alias("a")))
    text = F.concat(F.lit('{"turns": ['), F.get_json_object(item, "$.a"), F.lit(', {"start_time_ms": 500, "end_time_ms": '), F.col("k").cast("string"), F.lit(', "speaker": "b", "text": "x"}]}'))
    parsed = G.parse_transcripts(props.select("event_id", text.alias("json")), ["event_id"])
    return parsed.select("event_id", "segment_id", "channel", "speaker", "text", F.round("end_sec", 6).alias("end_sec"), "valid")


def segment_frame_bounds(spark: SparkSession, base: str) -> DataFrame:
    """Frames of each segment at the models' two rates."""
    rows = _valid(spark, base).select("source_dataset_id", "segment_id", (F.col("start_ms") / 1000).alias("start_sec"), (F.col("end_ms") / 1000).alias("end_sec"))
    bounds = G.frame_bounds(rows.withColumn("rate", F.explode(F.array(F.lit(12.5), F.lit(21.0)))), F.col("rate"), F.lit(1 << 40))
    return bounds.select("source_dataset_id", "segment_id", "rate", "frame_start", "frame_end")


def _bounds(spark: SparkSession, base: str) -> DataFrame:
    rows = _valid(spark, base, "source_audio_channel_id").select("source_dataset_id", "source_audio_channel_id", "segment_id", (F.col("start_ms") / 1000).alias("start_sec"), (F.col("end_ms") / 1000).alias("end_sec"))
    return G.frame_bounds(rows, F.lit(12.5), F.lit(1 << 40))


def segment_frames_range_join(spark: SparkSession, base: str) -> DataFrame:
    """How many segments hold each frame, by channel: an interval join of all frames and segments. Frames that none holds have no row."""
    by = ["source_dataset_id", "source_audio_channel_id"]
    b = store(_bounds(spark, base), "bounds")
    last = b.groupBy(*by).agg(F.max("frame_end").alias("n"))
    frames = last.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame"))
    return G.frames_of_segments(b, frames, by, "frame").groupBy(*by, "frame").agg(F.count(F.lit(1)).alias("n_segments"))


def segment_frames_all(spark: SparkSession, base: str) -> DataFrame:
    """The same as segment_frames_range_join, by its earlier name."""
    return segment_frames_range_join(spark, base)


def channel_frames(spark: SparkSession, base: str) -> DataFrame:
    return G.covered_frames(_bounds(spark, base), ["source_dataset_id", "source_audio_channel_id"])


def speaker_first_appearance(spark: SparkSession, base: str) -> DataFrame:
    return G.speaker_numbers(_valid(spark, base, "speaker"))


def words_per_second_gate(spark: SparkSession, base: str) -> DataFrame:
    s = _valid(spark, base, "text").where("text is not null")
    return s.select("source_dataset_id", "segment_id", S.word_count(F.col("text")).cast("int").alias("words"), S.is_collapsed(F.col("text"), F.col("length_ms") / 1000).alias("collapsed"))


def context_window(spark: SparkSession, base: str) -> DataFrame:
    """The earlier turns that fit 30 seconds, for each segment of a recording in order of its number."""
    out = trimmed_context(store(_valid(spark, base), "turns"), ["source_dataset_id"], F.floor(F.col("segment_id") / SPAN_SEQUENCES), ["segment_id"], "length_ms", 30_000)
    return out.select("source_dataset_id", "segment_id", "context_turns", "context_ms")


def stitch_offsets(spark: SparkSession, base: str) -> DataFrame:
    """Where each segment begins if a recording's segments are put one after another with gaps of 300 ms."""
    out = D.stitch(store(_valid(spark, base), "turns"), ["source_dataset_id"], F.floor(F.col("segment_id") / SPAN_SEQUENCES), ["segment_id"], "length_ms", 300)
    return out.select("source_dataset_id", "segment_id", "offset_ms")


def retry_pick(spark: SparkSession, base: str) -> DataFrame:
    """Of the copies of a record, written one after another, the first of three with frames, else the last of them."""
    rows = shard_records(table(spark, base, "shard_meta")).withColumn("frames", F.coalesce("audio_frames", F.lit(0)))
    out = D.pick_attempt(rows, ["model", "row_id", "seq_id"], ["written_at", "n_bytes"], F.col("frames") > 0, ["n_bytes"])
    return out.select("model", "row_id", "seq_id", "n_bytes", F.col("attempt_no").cast("int").alias("attempt_no"), "is_good")


def missing_rows_anti(spark: SparkSession, base: str) -> DataFrame:
    """Recordings with segments that raw_rows doesn't have, and the other way round."""
    raw, seg = table(spark, base, "raw_rows").select("row_id"), table(spark, base, "segments").select(F.col("source_dataset_id").alias("row_id"))
    return missing(seg, raw, "row_id").withColumn("side", F.lit("raw_rows")).unionByName(missing(raw, seg, "row_id").withColumn("side", F.lit("segments")))


def selected_rows_semi(spark: SparkSession, base: str) -> DataFrame:
    """Segments per recording of the data set tideway."""
    raw = table(spark, base, "raw_rows").where(F.lower(F.trim("dataset")) == "tideway").select(F.col("row_id").alias("source_dataset_id"))
    return selected(table(spark, base, "segments"), raw, "source_dataset_id").groupBy("source_dataset_id").agg(F.count(F.lit(1)).alias("n"))


def rows_exceptall(spark: SparkSession, base: str) -> DataFrame:
    """Stored copies of segments beyond the first."""
    keys = table(spark, base, "segments").select("source_dataset_id", "segment_id")
    return keys.exceptAll(keys.distinct())


def union_groups(spark: SparkSession, base: str) -> DataFrame:
    """Recordings by what tells of them."""
    parts = [table(spark, base, t).select(F.col(c).alias("row_id"), F.lit(t).alias("source")).where("row_id is not null") for t, c in (("raw_rows", "row_id"), ("segments", "source_dataset_id"), ("model_metrics", "row_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count_distinct("row_id").alias("n"))


def row_counts(spark: SparkSession, base: str) -> DataFrame:
    raw = table(spark, base, "raw_rows")
    return raw.groupBy(F.coalesce(F.lower(F.trim("dataset")), F.lit("-")).alias("dataset")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("n_recordings"))


# ---------------------------------------------------------------- spans


def _spans(spark: SparkSession, base: str) -> DataFrame:
    return P.spans_once(table(spark, base, "spans"))


def span_offsets(spark: SparkSession, base: str) -> DataFrame:
    """The running position of each span, and whether it is where the table has it."""
    return P.offsets(_spans(spark, base)).select("model", "row_id", "seq_id", "span_no", "offset", (F.col("offset") == F.col("span_start")).alias("agrees"))


def spans_of_kind(spark: SparkSession, base: str) -> DataFrame:
    s = _spans(spark, base)
    parts = [P.spans_of(s, k) for k in P.KINDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("model", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("span_end") - F.col("span_start")).alias("n_tokens"))


def span_kind_pivot(spark: SparkSession, base: str) -> DataFrame:
    """Text and audio of each segment side by side; -1 where it has none."""
    p = P.pivot_kinds(_spans(spark, base))
    return p.select(*P.SEQUENCE, "segment_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("text_start", "text_end", "audio_start", "audio_end")])


def span_checks(spark: SparkSession, base: str) -> DataFrame:
    return P.check_spans(_spans(spark, base)).groupBy("model", "reason").agg(F.count(F.lit(1)).alias("n"))


def audio_feature_slice(spark: SparkSession, base: str) -> DataFrame:
    return P.feature_slices(_spans(spark, base)).select(*P.SEQUENCE, "span_no", "feature_start", "feature_end")


def sequence_length_gate(spark: SparkSession, base: str) -> DataFrame:
    """Sequences over a limit of 512 tokens."""
    return P.sequence_lengths(_spans(spark, base)).where("n_tokens > 512")


def template_spans(spark: SparkSession, base: str) -> DataFrame:
    """Each segment as a sequence of its own: a token per byte of '[id] text', audio at 12.5 Hz, six prefix tokens and one at the end."""
    s = _valid(spark, base, "text").where("text is not null")
    text = F.octet_length(F.concat(F.lit("[0] "), F.ltrim("text")))
    frames = F.ceil(F.col("end_ms") * 12.5 / 1000) - F.floor(F.col("start_ms") * 12.5 / 1000)
    placed = P.template(s, text, frames, 6, 1, ["segment_id"], ["source_dataset_id", "segment_id"])
    return placed.select("source_dataset_id", "segment_id", "piece", "kind", "span_start", "span_end")


def packed_sequences(spark: SparkSession, base: str) -> DataFrame:
    """Consecutive sequences of a row packed up to 2048 tokens."""
    lengths = P.sequence_lengths(_spans(spark, base))
    return greedy_pack(lengths, ["model", "row_id"], ["seq_id"], "n_tokens", 2048).select("model", "row_id", "seq_id", "chunk_no", "oversized")


def contiguous_spans(spark: SparkSession, base: str) -> DataFrame:
    """Runs of errors of each user, in order of time."""
    events = table(spark, base, "events")
    return islands(events, ["user_id"], None, ["ts", "event_id"], F.col("event_type") == "error")


def ras_repeat_flag(spark: SparkSession, base: str) -> DataFrame:
    """Whether an event's value k was among the user's last ten."""
    events = table(spark, base, "events").select("user_id", "event_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"))
    at = numbered(events, ["user_id"], None, ["ts", "event_id"], "pos")
    return with_recent(at, ["user_id"], "pos", "k", 10, "recent").select("event_id", F.array_contains("recent", F.col("k")).alias("repeated"))


def token_mask_validate(spark: SparkSession, base: str) -> DataFrame:
    """Lines as rows of a grid (quantity, size, 0) with masks from their status; reasons why orders' grids are unsound."""
    tokens, on = F.array(F.col("l_quantity").cast("int"), F.lit(0), F.col("l_linenumber")), F.col("l_linestatus") == "O"
    worst = P.check_row(tokens, F.array(on, on, F.lit(True)), F.lit(2), F.lit(2))
    grids = table(spark, base, "lineitem").groupBy("l_orderkey").agg(F.max(worst).alias("worst"))
    return grids.groupBy(F.get(F.array(*[F.lit(r) for r in P.GRID_REASONS]), F.col("worst")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def layout_columns(spark: SparkSession, base: str) -> DataFrame:
    """The text column of each layout and the audio channels, as text."""
    k, c = F.col("num_codebooks"), F.col("text_channel")
    return table(spark, base, "layouts").select("model", S.text_column(c, k).alias("text_column"), F.array_join(S.audio_channels(c, k).cast("array<string>"), ",").alias("audio_channels"))


QUERIES = {f.__name__: f for f in (
    segment_checks, transcript_json_parse, segment_frame_bounds, segment_frames_range_join, segment_frames_all, channel_frames, speaker_first_appearance, words_per_second_gate, context_window, stitch_offsets, retry_pick,
    missing_rows_anti, selected_rows_semi, rows_exceptall, union_groups, row_counts, span_offsets, spans_of_kind, span_kind_pivot, span_checks, audio_feature_slice, sequence_length_gate,
    template_spans, packed_sequences, contiguous_spans, ras_repeat_flag, token_mask_validate, layout_columns,
)}

_V = """
  v AS (SELECT source_dataset_id, segment_id, any_value(source_audio_channel_id) AS source_audio_channel_id, any_value(text) AS text, any_value(speaker) AS speaker, any_value(s) AS start_ms, any_value(e) AS end_ms, any_value(e - s) AS n
        FROM (SELECT *, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS e FROM segments WHERE round(end_sec * 1000) > round(start_sec * 1000)) GROUP BY source_dataset_id, segment_id)
"""
_B = f"{_V}, b AS (SELECT *, CAST(floor(start_ms / 1000 * 12.5) AS BIGINT) AS fs, CAST(ceil(end_ms / 1000 * 12.5) AS BIGINT) AS fe FROM v)"
_S = """
  s AS (SELECT lower(trim(model)) AS model, row_id, seq_id, span_no, lower(trim(span_kind)) AS kind, source_dataset_id, segment_id, span_start, span_end FROM spans
        QUALIFY row_number() OVER (PARTITION BY lower(trim(model)), row_id, seq_id, span_no ORDER BY span_start, span_end, kind NULLS FIRST, source_dataset_id NULLS FIRST, segment_id NULLS LAST) = 1)
"""
_SEQ = "model, row_id, seq_id"
_RECORD = r"""
  SELECT coalesce(nullif(lower(trim(model)), ''), lower(split_part(shard_file, '/', 2))) AS model, coalesce(row_id, TRY_CAST(regexp_extract(sample_key, '(\d+)[_-](\d+)', 1) AS BIGINT)) AS row_id,
         coalesce(seq_id, TRY_CAST(regexp_extract(sample_key, '(\d+)[_-](\d+)', 2) AS INT)) AS seq_id, coalesce(audio_frames, 0) > 0 AS ok, n_bytes, written_at FROM shard_meta
"""
SQL = {
    "segment_checks": """
        WITH r AS (SELECT row_id, arg_max(num_channels, added_at) AS c, arg_max(duration_sec, added_at) AS d, arg_max(sample_rate, added_at) AS k FROM (SELECT DISTINCT * FROM raw_rows) GROUP BY 1)
        SELECT CASE WHEN row_id IS NULL THEN 'no recording' WHEN start_sec IS NULL OR end_sec IS NULL OR isnan(start_sec) OR isnan(end_sec) THEN 'no time' WHEN end_sec <= start_sec THEN 'reversed'
               WHEN source_audio_channel_id >= c THEN 'channel' WHEN start_sec < 0 THEN 'negative' WHEN NOT isnan(d) AND end_sec > d + 1.0::DOUBLE / k THEN 'late' ELSE 'ok' END AS reason, count(*) AS n
        FROM segments LEFT JOIN r ON source_dataset_id = row_id GROUP BY 1""",
    "transcript_json_parse": """
        WITH k AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
        SELECT event_id, 0 AS segment_id, CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS channel, 'speaker' AS speaker, '' AS text, round(value, 6) AS end_sec, value > 0 AS valid FROM k
        UNION ALL SELECT event_id, 1, 0, 'b', 'x', round(k / 1000, 6), k > 500 FROM k""",
    "segment_frame_bounds": f"""WITH {_V} SELECT source_dataset_id, segment_id, rate, CAST(floor(start_ms / 1000 * rate) AS BIGINT) AS frame_start, CAST(ceil(end_ms / 1000 * rate) AS BIGINT) AS frame_end
        FROM v, (VALUES (12.5::DOUBLE), (21.0::DOUBLE)) r(rate)""",
    "segment_frames_range_join": f"""WITH {_B}, l AS (SELECT source_dataset_id, source_audio_channel_id, max(fe) AS n FROM b GROUP BY ALL),
        f AS (SELECT source_dataset_id, source_audio_channel_id, unnest(range(n)) AS frame FROM l)
        SELECT f.source_dataset_id, f.source_audio_channel_id, frame, count(*) AS n_segments FROM f JOIN b ON b.source_dataset_id = f.source_dataset_id AND b.source_audio_channel_id = f.source_audio_channel_id AND frame >= fs AND frame < fe GROUP BY ALL""",
    "segment_frames_all": f"""WITH {_B}, f AS (SELECT source_dataset_id, source_audio_channel_id, unnest(range(fs, fe)) AS frame FROM b)
        SELECT source_dataset_id, source_audio_channel_id, frame, count(*) AS n_segments FROM f GROUP BY ALL""",
    "channel_frames": f"""WITH {_B}, x AS (SELECT *, unnest(range(fs // 256, (fe - 1) // 256 + 1)) AS bin FROM b)
        SELECT source_dataset_id, source_audio_channel_id, bin, count(*) AS n_segments, CAST(sum(least(fe, (bin + 1) * 256) - greatest(fs, bin * 256)) AS BIGINT) AS n_frames FROM x GROUP BY ALL""",
    "speaker_first_appearance": f"""WITH {_V} SELECT source_dataset_id, speaker, CAST(row_number() OVER (PARTITION BY source_dataset_id ORDER BY min(segment_id), encode(speaker)) - 1 AS INT) AS speaker_no
        FROM v WHERE speaker IS NOT NULL GROUP BY source_dataset_id, speaker""",
    "context_window": f"""WITH {_V}, c AS (SELECT *, row_number() OVER w AS k, sum(n) OVER w AS e FROM v WINDOW w AS (PARTITION BY source_dataset_id ORDER BY segment_id))
        SELECT a.source_dataset_id, a.segment_id, count(b.k) AS context_turns, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS context_ms
        FROM c a LEFT JOIN c b ON a.source_dataset_id = b.source_dataset_id AND b.k < a.k AND (b.k = a.k - 1 OR a.e - a.n - (b.e - b.n) <= 30000) GROUP BY a.source_dataset_id, a.segment_id""",
    "stitch_offsets": f"""WITH {_V} SELECT source_dataset_id, segment_id, CAST(coalesce(sum(n + 300) OVER (PARTITION BY source_dataset_id ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM v""",
    "retry_pick": f"""WITH r AS ({_RECORD}), k AS (SELECT *, row_number() OVER (PARTITION BY {_SEQ} ORDER BY written_at, n_bytes) AS attempt_no FROM r)
        SELECT {_SEQ}, n_bytes, CAST(attempt_no AS INT) AS attempt_no, ok AS is_good FROM k WHERE attempt_no <= 3 QUALIFY row_number() OVER (PARTITION BY {_SEQ} ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN ok THEN attempt_no ELSE -attempt_no END) = 1""",
    "missing_rows_anti": """SELECT DISTINCT source_dataset_id AS row_id, 'raw_rows' AS side FROM segments WHERE source_dataset_id NOT IN (SELECT row_id FROM raw_rows)
        UNION ALL SELECT DISTINCT row_id, 'segments' FROM raw_rows WHERE row_id NOT IN (SELECT source_dataset_id FROM segments)""",
    "selected_rows_semi": "SELECT source_dataset_id, count(*) AS n FROM segments WHERE source_dataset_id IN (SELECT row_id FROM raw_rows WHERE lower(trim(dataset)) = 'tideway') GROUP BY 1",
    "rows_exceptall": "SELECT source_dataset_id, segment_id FROM segments EXCEPT ALL SELECT DISTINCT source_dataset_id, segment_id FROM segments",
    "union_groups": """SELECT 'raw_rows' AS source, count(DISTINCT row_id) AS n FROM raw_rows UNION ALL SELECT 'segments', count(DISTINCT source_dataset_id) FROM segments
        UNION ALL SELECT 'model_metrics', count(DISTINCT row_id) FROM model_metrics""",
    "row_counts": "SELECT coalesce(lower(trim(dataset)), '-') AS dataset, count(*) AS n_rows, count(DISTINCT row_id) AS n_recordings FROM raw_rows GROUP BY 1",
    "span_offsets": f"""WITH {_S}, o AS (SELECT *, CAST(coalesce(sum(span_end - span_start) OVER (PARTITION BY {_SEQ} ORDER BY span_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM s)
        SELECT {_SEQ}, span_no, "offset", "offset" = span_start AS agrees FROM o""",
    "spans_of_kind": f"WITH {_S} SELECT model, kind, count(*) AS n, CAST(sum(span_end - span_start) AS BIGINT) AS n_tokens FROM s GROUP BY ALL",
    "span_kind_pivot": f"""WITH {_S} SELECT {_SEQ}, segment_id, coalesce(arg_max(span_start, span_start) FILTER (kind = 'text'), -1) AS text_start, coalesce(arg_max(span_end, span_start) FILTER (kind = 'text'), -1) AS text_end,
        coalesce(arg_max(span_start, span_start) FILTER (kind = 'audio'), -1) AS audio_start, coalesce(arg_max(span_end, span_start) FILTER (kind = 'audio'), -1) AS audio_end FROM s WHERE segment_id IS NOT NULL GROUP BY {_SEQ}, source_dataset_id, segment_id""",
    "span_checks": f"""WITH {_S} SELECT model, CASE WHEN kind NOT IN ('text', 'audio', 'special') THEN 'kind' WHEN span_end <= span_start THEN 'empty' WHEN span_start < 0 THEN 'negative'
        WHEN kind = 'audio' AND span_start = 0 THEN 'first' ELSE 'ok' END AS reason, count(*) AS n FROM s GROUP BY ALL""",
    "audio_feature_slice": f"WITH {_S} SELECT {_SEQ}, span_no, span_start - 1 AS feature_start, span_end - 1 AS feature_end FROM s WHERE kind = 'audio' AND span_start >= 1 AND span_end > span_start",
    "sequence_length_gate": f"WITH {_S} SELECT {_SEQ}, max(span_end) AS n_tokens FROM s GROUP BY {_SEQ} HAVING max(span_end) > 512",
    "template_spans": f"""WITH {_V}, p AS (SELECT source_dataset_id, segment_id, unnest([0, 1, 2, 3]) AS piece, unnest(['text', 'special', 'audio', 'special']) AS kind,
          unnest([octet_length(encode('[0] ' || ltrim(text, ' '))), 6, CAST(ceil(end_ms * 12.5 / 1000) - floor(start_ms * 12.5 / 1000) AS BIGINT), 1]) AS n FROM v WHERE text IS NOT NULL)
        SELECT source_dataset_id, segment_id, piece, kind, CAST(sum(n) OVER w - n AS BIGINT) AS span_start, CAST(sum(n) OVER w AS BIGINT) AS span_end FROM p WHERE n > 0
        WINDOW w AS (PARTITION BY source_dataset_id, segment_id ORDER BY piece ROWS UNBOUNDED PRECEDING)""",
    "packed_sequences": f"""WITH RECURSIVE {_S}, l AS (SELECT {_SEQ}, max(span_end) AS n, row_number() OVER (PARTITION BY model, row_id ORDER BY seq_id) AS k FROM s GROUP BY {_SEQ}),
        w AS (SELECT model, row_id, seq_id, k, n, CAST(n AS BIGINT) AS fill, CAST(0 AS BIGINT) AS chunk_no FROM l WHERE k = 1
              UNION ALL SELECT l.model, l.row_id, l.seq_id, l.k, l.n, CASE WHEN w.fill + l.n <= 2048 THEN w.fill + l.n ELSE l.n END, CASE WHEN w.fill + l.n <= 2048 THEN w.chunk_no ELSE w.chunk_no + 1 END
              FROM w JOIN l ON l.model = w.model AND l.row_id = w.row_id AND l.k = w.k + 1)
        SELECT model, row_id, seq_id, chunk_no, n > 2048 AS oversized FROM w""",
    "contiguous_spans": """WITH n AS (SELECT user_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
        r AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM n WHERE f) SELECT user_id, min(pos) AS span_start, max(pos) + 1 AS span_end FROM r GROUP BY user_id, g""",
    "ras_repeat_flag": """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
        SELECT event_id, coalesce(list_contains(list(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), k), false) AS repeated FROM e""",
    "token_mask_validate": """WITH o AS (SELECT l_orderkey, bool_and(l_linestatus = 'O' OR CAST(l_quantity AS INT) = 0) AS sound FROM lineitem GROUP BY 1)
        SELECT CASE WHEN sound THEN 'ok' ELSE 'audio' END AS reason, count(*) AS n FROM o GROUP BY 1""",
    "layout_columns": """SELECT model, (text_channel + num_codebooks + 1) % (num_codebooks + 1) AS text_column,
        array_to_string(list_filter(range(num_codebooks + 1), lambda c: c <> (text_channel + num_codebooks + 1) % (num_codebooks + 1)), ',') AS audio_channels FROM layouts""",
    "words_per_second_gate": f"""WITH {_V}, w AS (SELECT *, CAST(len(list_filter(regexp_split_to_array(text, '[\\s\\x0b\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '')) AS INT) AS words FROM v WHERE text IS NOT NULL)
        SELECT source_dataset_id, segment_id, words, words > 0 AND NOT words / greatest(n / 1000, 1e-6) BETWEEN 1.5 AND 5.0 AS collapsed FROM w""",
}
