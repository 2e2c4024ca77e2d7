"""Queries on logits. A row of embeddings is one frame: 64 floats as 4 codebooks of 16 logits each.

The target of codebook k is (label + 3k) mod 16; 50 frames make a sequence, 5 sequences a row; 12.5 frames
a second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.functions import logits as L
from murmuro.functions.grids import feature_layout, head_targets
from murmuro.functions.scalars import kbits_per_second
from murmuro.operators.metrics import audio_frame_metrics
from murmuro.operators.spans import scatter, teacher_forced
from murmuro.session import table

RATE, BOOKS, SIZE = 12.5, 4, 16


def frames(spark: SparkSession, base: str) -> DataFrame:
    wide = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    heads = F.transform(F.sequence(F.lit(0), F.lit(BOOKS - 1)), lambda k: F.slice(wide, k * SIZE + 1, F.lit(SIZE)))
    targets = F.transform(F.sequence(F.lit(0), F.lit(BOOKS - 1)), lambda k: F.pmod(F.col("label") + 3 * k, F.lit(SIZE)).cast("int"))
    return table(spark, base, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 250).alias("row_id"), F.floor(F.col("vec_id") / 50).alias("seq_id"), "label", heads.alias("logits"), targets.alias("targets"))


def _heads(spark: SparkSession, base: str) -> DataFrame:
    """A row for each frame and head, with the head's logits and target."""
    f = frames(spark, base)
    flat = f.select("vec_id", "seq_id", "label", "targets", F.posexplode("logits").alias("head", "lg"))
    return flat.withColumn("target", F.get("targets", F.col("head"))).drop("targets")


def _uniform(*key: Column) -> Column:
    """A number above 0 and below 1 from the first 32 bits of a hash, so that a draw can be repeated."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 8), 16, 10).cast("long") + 1) / float(2**32 + 1)


def _noise(name: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda i: _uniform(F.lit(name), F.col("vec_id"), F.col("head"), i))


def _r(x: Column) -> Column:
    return F.round(x, 6)


def frame_nll_entropy(spark: SparkSession, base: str) -> DataFrame:
    scored = audio_frame_metrics(frames(spark, base).drop("label"), "logits", "targets")
    return scored.select("vec_id", "codebook", _r(F.col("nll")).alias("nll"), _r(F.col("entropy")).alias("entropy"))


def flagship_nll_rollup(spark: SparkSession, base: str) -> DataFrame:
    """NLL, entropy and bitrate of each codebook, of both groups and of all, in one aggregation."""
    scored = audio_frame_metrics(frames(spark, base).drop("label"), "logits", "targets")
    scope = F.when(F.col("codebook") == 0, "semantic").otherwise("audio")
    sets = scored.withColumn("scope", scope).rollup("scope", "codebook").agg(F.avg("nll").alias("avg_nll"), F.avg("entropy").alias("avg_entropy"), F.count_distinct("codebook").alias("num_codebooks"), F.grouping_id().alias("level"))
    kbps = kbits_per_second(F.col("avg_nll"), F.lit(RATE), F.col("num_codebooks"))
    return sets.select(F.coalesce("scope", F.lit("total")).alias("scope"), F.when(F.col("level") == 0, F.col("codebook").cast("string")).otherwise("-").alias("codebook"), "num_codebooks", _r(F.col("avg_nll")).alias("avg_nll"), _r(F.col("avg_entropy")).alias("avg_entropy"), _r(kbps).alias("kbps"))


def teacher_forced_join(spark: SparkSession, base: str) -> DataFrame:
    """Each position's logits score the token one place later, for every head."""
    f = _heads(spark, base).withColumn("pos", F.pmod("vec_id", F.lit(50)).cast("int"))
    features, tokens = f.select("seq_id", "head", F.col("pos").alias("feature_pos"), "lg"), f.select("seq_id", "head", "pos", F.col("target").alias("token"))
    return teacher_forced(features, tokens, ["seq_id", "head"]).select("seq_id", "head", "feature_pos", "token", _r(L.nll(F.col("lg"), F.col("token"))).alias("nll"))


def head_target_gather(spark: SparkSession, base: str) -> DataFrame:
    """What each head of each model's layout predicts, in grids whose cell is 100 times its row and its column."""
    n = F.col("num_codebooks")
    grid = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.transform(F.sequence(F.lit(0), n), lambda c: r * 100 + c))
    found = table(spark, base, "layouts").select("model", F.posexplode(head_targets(grid, F.col("head_targets"))).alias("pos", "t"))
    return found.select("model", "pos", F.posexplode("t").alias("head", "token"))


def argmax_token(spark: SparkSession, base: str) -> DataFrame:
    return _heads(spark, base).select("vec_id", "head", L.argmax(F.col("lg")).alias("token"))


def _kept(lg: Column) -> Column:
    return F.size(F.filter(lg, lambda x: x > float("-inf"))).cast("int")


def topk_filter(spark: SparkSession, base: str) -> DataFrame:
    kept = L.top_k(F.col("lg"), 5)
    finite = lambda lg: F.filter(lg, lambda x: x > float("-inf"))
    return _heads(spark, base).select("vec_id", "head", _kept(kept).alias("n_kept"), _r(F.array_min(finite(kept))).alias("least"))


def top_p_filter(spark: SparkSession, base: str) -> DataFrame:
    """How many ids a nucleus of 0.5 keeps, and the sum of their numbers."""
    ids = L.nucleus(F.transform("lg", lambda x: x * 8), 0.5)
    return _heads(spark, base).select("vec_id", "head", ids.alias("ids")).select("vec_id", "head", F.size("ids").cast("int").alias("n_kept"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


def min_p_filter(spark: SparkSession, base: str) -> DataFrame:
    return _heads(spark, base).select("vec_id", "head", _kept(L.min_p(F.transform("lg", lambda x: x * 8), 0.3)).alias("n_kept"))


def fused_filter(spark: SparkSession, base: str) -> DataFrame:
    """Temperature 0.125, the ten best, of these a nucleus of 0.9, of that what has 0.05 of the best; id 15 ends a sequence and stays."""
    out = L.fused_filters(F.col("lg"), 0.125, 10, 0.9, 0.05, SIZE - 1)
    return _heads(spark, base).select("vec_id", "head", _kept(out).alias("n_kept"), (F.get(out, F.lit(SIZE - 1)) > float("-inf")).alias("end_kept"))


def rep_penalty(spark: SparkSession, base: str) -> DataFrame:
    """Logits after a penalty of 1.3 on two ids."""
    seen = F.array(F.pmod("label", F.lit(SIZE)), F.pmod(F.col("label") + 5, F.lit(SIZE)))
    out = L.repetition_penalty(F.col("lg"), F.transform(seen, lambda x: x.cast("int")), 1.3)
    return _heads(spark, base).select("vec_id", "head", L.argmax(out).alias("token"), _r(F.aggregate(out, F.lit(0.0), lambda a, x: a + x)).alias("total"))


def suppress_tokens(spark: SparkSession, base: str) -> DataFrame:
    """The best id once the eight lowest ids are ruled out."""
    return _heads(spark, base).select("vec_id", "head", L.argmax(L.suppress(F.col("lg"), F.sequence(F.lit(0), F.lit(7)))).alias("token"))


def temperature_softmax(spark: SparkSession, base: str) -> DataFrame:
    """The highest probability at temperature 0.5."""
    return _heads(spark, base).select("vec_id", "head", _r(F.array_max(L.softmax(L.temperature(F.col("lg"), 0.5)))).alias("p"))


def gumbel_race_sample(spark: SparkSession, base: str) -> DataFrame:
    """A draw per frame and head."""
    return _heads(spark, base).select("vec_id", "head", L.race(F.col("lg"), _noise("race")).alias("token"))


def sampled_token(spark: SparkSession, base: str) -> DataFrame:
    """What the frame sampler draws at temperature 0.7 with the eight best ids and a nucleus of 0.6, and at temperature 0."""
    warm, cold = L.sample(F.col("lg"), _noise("draw"), 0.7, 8, 0.6), L.sample(F.col("lg"), _noise("draw"), 0.0, 8, 0.6)
    return _heads(spark, base).select("vec_id", "head", warm.alias("token"), cold.alias("greedy"))


def repetition_aware_sample(spark: SparkSession, base: str) -> DataFrame:
    """A draw from a nucleus of 0.2, drawn again from one of 0.9 where an id up to 11 is among three recent ones."""
    recent = F.transform(F.array(F.lit(0), F.lit(4), F.lit(9)), lambda k: F.pmod(F.col("label") + k, F.lit(SIZE)).cast("int"))
    rows = _heads(spark, base).select("vec_id", "head", "label", F.transform("lg", lambda x: x * 8).alias("lg"), _noise("first").alias("one"), _noise("again").alias("two"))
    return rows.select("vec_id", "head", L.repetition_aware(F.col("lg"), recent, F.col("one"), F.col("two"), 0.2, SIZE, 0, 11).alias("token"))


def scatter_fill_zero(spark: SparkSession, base: str) -> DataFrame:
    """The values of every second frame placed on all positions of their sequence, zero elsewhere."""
    f = table(spark, base, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("seq_id"), F.pmod("vec_id", F.lit(50)).cast("int").alias("pos"), "label")
    values = f.where("label >= 5").select("seq_id", "pos", F.col("label").cast("double").alias("v"))
    return scatter(values, f.groupBy("seq_id").agg((F.max("pos") + 1).alias("n")), ["seq_id"], "pos", "v")


def uniform_nll(spark: SparkSession, base: str) -> DataFrame:
    """The NLL of a model that knows nothing: ln of the number of logits of each head, by how many frames have it."""
    widths = frames(spark, base).select(F.posexplode(feature_layout(F.col("logits"), F.transform("logits", lambda h: F.array(h)))["logit_dims"]).alias("head", "width"))
    return widths.groupBy("head", "width").agg(F.count(F.lit(1)).alias("n_frames")).select("head", "n_frames", _r(F.ln("width")).alias("nll"))


QUERIES = {f.__name__: f for f in (
    flagship_nll_rollup, frame_nll_entropy, teacher_forced_join, head_target_gather, argmax_token, topk_filter, top_p_filter, min_p_filter, fused_filter, rep_penalty, suppress_tokens,
    temperature_softmax, gumbel_race_sample, sampled_token, repetition_aware_sample, scatter_fill_zero, uniform_nll,
)}

_SCORED = """
  f AS (SELECT vec_id, label, CAST(k AS INT) AS codebook, list_transform(embedding[k * 16 + 1 : k * 16 + 16], lambda x: CAST(x AS DOUBLE)) AS lg, CAST((label + 3 * k) % 16 AS INT) AS target
        FROM embeddings, range(4) r(k)),
  z AS (SELECT *, list_max(lg) + ln(list_sum(list_transform(lg, lambda x: exp(x - list_max(lg))))) AS lse FROM f),
  s AS (SELECT *, lse - lg[target + 1] AS nll, -list_sum(list_transform(lg, lambda x: exp(x - lse) * (x - lse))) AS entropy FROM z)
"""
_LONG = """h AS (SELECT vec_id, label, CAST(k AS INT) AS head, list_transform(embedding[k * 16 + 1 : k * 16 + 16], lambda x: CAST(x AS DOUBLE)) AS lg FROM embeddings, range(4) r(k)),
  e AS (SELECT vec_id, head, label, CAST(i AS INT) AS i, lg[i + 1] AS x FROM h, range(16) r(i))"""
_AT = "vec_id, head"
_SOFT = "p AS (SELECT vec_id, head, label, i, x, exp(8 * x) / sum(exp(8 * x)) OVER (PARTITION BY vec_id, head) AS p FROM e)"


def _race_sql(p: str, name: str) -> str:
    """What decides a race: the highest p over -ln of noise."""
    return f"({p}) / -ln((CAST('0x' || substr(md5('{name}:' || vec_id || ':' || head || ':' || i), 1, 8) AS BIGINT) + 1) / 4294967297::DOUBLE)"


SQL = {
    "frame_nll_entropy": f"WITH {_SCORED} SELECT vec_id, codebook, round(nll, 6) AS nll, round(entropy, 6) AS entropy FROM s",
    "flagship_nll_rollup": f"""WITH {_SCORED}, g AS (SELECT *, CASE WHEN codebook = 0 THEN 'semantic' ELSE 'audio' END AS scope FROM s)
        SELECT coalesce(scope, 'total') AS scope, coalesce(CAST(codebook AS VARCHAR), '-') AS codebook, count(DISTINCT c) AS num_codebooks, round(avg(nll), 6) AS avg_nll, round(avg(entropy), 6) AS avg_entropy,
               round(avg(nll) / ln(2) * 12.5 * count(DISTINCT c) / 1000, 6) AS kbps
        FROM (SELECT *, codebook AS c FROM g) GROUP BY ROLLUP (scope, codebook)""",
    "teacher_forced_join": f"""WITH {_SCORED} SELECT a.vec_id // 50 AS seq_id, a.codebook AS head, CAST(a.vec_id % 50 AS INT) AS feature_pos, b.target AS token, round(a.lse - a.lg[b.target + 1], 6) AS nll
        FROM s a JOIN s b ON b.vec_id = a.vec_id + 1 AND b.vec_id // 50 = a.vec_id // 50 AND a.codebook = b.codebook""",
    "head_target_gather": """SELECT model, CAST(pos AS INT) AS pos, CAST(head AS INT) AS head, CAST(pos * 100 + t AS INT) AS token
        FROM (SELECT model, unnest(head_targets) AS t, generate_subscripts(head_targets, 1) - 1 AS head FROM layouts), range(4) r(pos)""",
    "argmax_token": f"WITH {_LONG} SELECT {_AT}, CAST(arg_min(i, (-x, i)) AS INT) AS token FROM e GROUP BY {_AT}",
    "topk_filter": f"""WITH {_LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY {_AT} ORDER BY x DESC, i) AS k FROM e)
        SELECT {_AT}, CAST(count(*) AS INT) AS n_kept, round(min(x), 6) AS least FROM r WHERE k <= 5 GROUP BY {_AT}""",
    "top_p_filter": f"""WITH {_LONG}, {_SOFT}, r AS (SELECT *, row_number() OVER w AS k, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS mass FROM p WINDOW w AS (PARTITION BY {_AT} ORDER BY x DESC, i))
        SELECT {_AT}, CAST(count(*) AS INT) AS n_kept, CAST(sum(i) AS BIGINT) AS id_sum FROM r WHERE k = 1 OR mass <= 0.5 GROUP BY {_AT}""",
    "min_p_filter": f"WITH {_LONG}, {_SOFT} SELECT {_AT}, CAST(count(*) AS INT) AS n_kept FROM (SELECT *, max(x) OVER (PARTITION BY {_AT}) AS top FROM p) WHERE 8 * x - 8 * top >= ln(0.3) GROUP BY {_AT}",
    "fused_filter": f"""WITH {_LONG}, t AS (SELECT {_AT}, i, x, row_number() OVER (PARTITION BY {_AT} ORDER BY x DESC, i) AS k FROM e),
        q AS (SELECT *, exp(8 * x) / sum(exp(8 * x)) OVER (PARTITION BY {_AT}) AS p FROM t WHERE k <= 10), m AS (SELECT *, sum(p) OVER (PARTITION BY {_AT} ORDER BY k ROWS UNBOUNDED PRECEDING) AS mass, max(x) OVER (PARTITION BY {_AT}) AS top FROM q),
        s AS (SELECT {_AT}, i FROM m WHERE (k = 1 OR mass <= 0.9) AND 8 * x - 8 * top >= ln(0.05) UNION SELECT {_AT}, 15 FROM h)
        SELECT {_AT}, CAST(count(*) AS INT) AS n_kept, bool_or(i = 15) AS end_kept FROM s GROUP BY {_AT}""",
    "rep_penalty": f"""WITH {_LONG}, r AS (SELECT {_AT}, i, CASE WHEN i <> label % 16 AND i <> (label + 5) % 16 THEN x WHEN x < 0 THEN x * 1.3 ELSE x / 1.3::DOUBLE END AS y FROM e)
        SELECT {_AT}, CAST(arg_min(i, (-y, i)) AS INT) AS token, round(sum(y), 6) AS total FROM r GROUP BY {_AT}""",
    "suppress_tokens": f"WITH {_LONG} SELECT {_AT}, CAST(arg_min(i, (-x, i)) AS INT) AS token FROM e WHERE i > 7 GROUP BY {_AT}",
    "temperature_softmax": f"WITH {_LONG} SELECT {_AT}, round(max(exp(2 * x)) / sum(exp(2 * x)), 6) AS p FROM e GROUP BY {_AT}",
    "gumbel_race_sample": f"WITH {_LONG} SELECT {_AT}, CAST(arg_max(i, {_race_sql('exp(x)', 'race')}) AS INT) AS token FROM e GROUP BY {_AT}",
    "sampled_token": f"""WITH {_LONG}, t AS (SELECT {_AT}, i, x, row_number() OVER (PARTITION BY {_AT} ORDER BY x DESC, i) AS k FROM e),
        p AS (SELECT *, exp(x) / sum(exp(x)) OVER (PARTITION BY {_AT}) AS p FROM t), m AS (SELECT *, sum(p) OVER (PARTITION BY {_AT} ORDER BY k ROWS UNBOUNDED PRECEDING) AS mass FROM p)
        SELECT {_AT}, CAST(arg_max(i, {_race_sql('exp(x / 0.7::DOUBLE)', 'draw')}) FILTER (k = 1 OR (mass <= 0.6 AND k <= 8)) AS INT) AS token, CAST(arg_min(i, k) AS INT) AS greedy FROM m GROUP BY {_AT}""",
    "repetition_aware_sample": f"""WITH {_LONG}, {_SOFT}, m AS (SELECT *, row_number() OVER w AS k, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS mass FROM p WINDOW w AS (PARTITION BY {_AT} ORDER BY x DESC, i)),
        d AS (SELECT {_AT}, any_value(label) AS label, CAST(arg_max(i, {_race_sql('p', 'first')}) FILTER (k = 1 OR mass <= 0.2) AS INT) AS a, CAST(arg_max(i, {_race_sql('p', 'again')}) FILTER (k = 1 OR mass <= 0.9) AS INT) AS b FROM m GROUP BY {_AT})
        SELECT {_AT}, CASE WHEN a <= 11 AND a IN (label % 16, (label + 4) % 16, (label + 9) % 16) THEN b ELSE a END AS token FROM d""",
    "scatter_fill_zero": """WITH n AS (SELECT vec_id // 50 AS seq_id, max(vec_id % 50) AS m FROM embeddings GROUP BY 1), g AS (SELECT seq_id, unnest(range(m + 1)) AS pos FROM n)
        SELECT g.seq_id, CAST(g.pos AS INT) AS pos, coalesce(CAST(e.label AS DOUBLE), 0) AS v FROM g LEFT JOIN embeddings e ON e.vec_id = g.seq_id * 50 + g.pos AND e.label >= 5""",
    "uniform_nll": "SELECT CAST(k AS INT) AS head, count(*) AS n_frames, round(ln(16), 6) AS nll FROM embeddings, range(4) r(k) GROUP BY k",
}
