"""Queries on texts, tensors and whole pipelines."""

from __future__ import annotations

import json
import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.functions import scalars as S
from murmuro.operators import metrics as M
from murmuro.operators.models import ToyBackend, featurized, token_rows, tokenized
from murmuro.operators.models import audio_chunks as audio_chunks_of
from murmuro.operators.shards import shuffle_split
from murmuro.session import shared_dir, store, table
from murmuro.sources import checkpoints as C
from murmuro.sources import files
from murmuro.sources.tars import read_tars, write_tars


def slug_preview_format(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").where("text is not null and source is not null")
    return docs.select("doc_id", S.slug(F.concat(F.lit("org/"), "source", F.lit(" V2!"))).alias("slug"), F.length(S.preview(F.col("text"))).alias("n_preview"))


def prompt_lines(spark: SparkSession, base: str) -> DataFrame:
    """Prompts written as lines of JSON and read again: characters by source."""
    docs = table(spark, base, "documents").where("genre = 'prompt' and text is not null")
    line = F.to_json(F.struct("text"))
    return docs.select(F.coalesce("source", F.lit("-")).alias("source"), F.get_json_object(line, "$.text").alias("t")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("n_chars"))


def rope_row_permutation(spark: SparkSession, base: str) -> DataFrame:
    """Where each vector goes if vectors are rows of heads of 10 interleaved dimensions."""
    return table(spark, base, "embeddings").select("vec_id", S.rope_row(F.col("vec_id"), F.lit(10)).alias("target"))


def key_rename(spark: SparkSession, base: str) -> DataFrame:
    return C.key_names(spark).select("source", "target")


def key_differences(spark: SparkSession, base: str) -> DataFrame:
    """Wanted tensors against a checkpoint that has two layers fewer and one tensor more."""
    wanted = C.key_names(spark, 8).select(F.col("source").alias("key"))
    found = C.key_names(spark, 6).select(F.col("source").alias("key")).unionByName(spark.createDataFrame([("decoder.extra",)], "key string"))
    return C.key_differences(wanted, found)


def param_counts(spark: SparkSession, base: str) -> DataFrame:
    """Numbers and bytes of vectors by label, as of tensors."""
    return table(spark, base, "embeddings").groupBy("label").agg(F.sum(F.size("embedding")).alias("n_values"), F.sum(F.size("embedding") * 4).alias("n_bytes"))


def speed_interp(spark: SparkSession, base: str) -> DataFrame:
    """Vectors played 1.6 times as fast: length, and the sum of the values."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    out = table(spark, base, "embeddings").select("vec_id", S.stretch(wide, F.lit(1.6)).alias("y"))
    return out.select("vec_id", F.size("y").alias("n"), F.round(F.aggregate("y", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def mono_mixdown(spark: SparkSession, base: str) -> DataFrame:
    """The halves of a vector as two channels, mixed to one: the largest value."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    mixed = S.mixdown(F.array(F.slice(wide, 1, 32), F.slice(wide, 33, 32)))
    return table(spark, base, "embeddings").select("vec_id", F.round(F.array_max(mixed), 6).alias("top"))


def audio_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Vectors in chunks of 24 values: sum per chunk."""
    rows = table(spark, base, "embeddings").select("vec_id", F.posexplode(audio_chunks_of(F.col("embedding"), 24)).alias("chunk", "x"))
    return rows.select("vec_id", F.col("chunk").cast("long").alias("chunk"), F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def text_tokens(spark: SparkSession, base: str) -> DataFrame:
    """The toy tokenizer, one id per byte, over all documents: ids by language."""
    docs = tokenized(table(spark, base, "documents").select("lang", "text"), F.col("text"), ToyBackend())
    return docs.groupBy(F.coalesce(F.lower("lang"), F.lit("-")).alias("lang")).agg(F.sum(F.size("text_ids")).alias("n_ids"))


def token_table(spark: SparkSession, base: str) -> DataFrame:
    """The toy tokenizer as a table function in SQL over the texts of nations and regions: ids by name."""
    token_rows(spark, ToyBackend())
    names = table(spark, base, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, base, "region").select(F.col("r_name").alias("name")))
    return spark.sql("SELECT name, count(*) AS n_ids, sum(t.token) AS id_sum, max(t.pos) AS last_pos FROM {names}, LATERAL token_rows(name) AS t GROUP BY name", names=names)


def checkpoint_scan(spark: SparkSession, base: str) -> DataFrame:
    """A checkpoint whose wanted tensors are read, renamed and permuted: first and last value of every row. Tensor k has values 1000 k, 1000 k + 1 and so on."""
    head, data, path = {}, b"", f"{shared_dir(spark)}/checkpoint-{uuid.uuid4().hex}.safetensors"
    for k, name in enumerate(TENSORS):
        values = np.arange(32, dtype="<f4") + 1000 * k
        head[name] = {"dtype": "F32", "shape": [8, 4], "data_offsets": [len(data), len(data) + values.nbytes]}
        data += values.tobytes()
    text = json.dumps(head).encode()
    with files.written(path) as f:
        f.write(struct.pack("<Q", len(text)) + text + data)
    names = C.key_names(spark, 1)
    wanted = names.join(C.tensor_index(spark, path).select(F.col("key").alias("source")), "source", "left_semi")
    rows = C.permuted(C.renamed(C.read_tensors(spark, path, wanted), names), F.col("key").rlike("[qk]_proj"), F.lit(4))
    return rows.select("key", "row", F.get("vector", F.lit(0)).cast("double").alias("first"), F.get("vector", F.lit(3)).cast("double").alias("last"))


#: Tensors of the file that checkpoint_scan makes; one isn't wanted.
TENSORS = ("projection.weight", "decoder.layers.0.attn.q_proj.weight", "decoder.extra", "decoder.layers.0.mlp.w1.weight")


def toy_pipeline_e2e(spark: SparkSession, base: str) -> DataFrame:
    """All recordings of a positive, finite duration to codes, logits, frame metrics and a summary, with the backend that needs no weights."""
    backend = ToyBackend()
    rows = table(spark, base, "raw_rows").where("duration_sec > 0 and duration_sec < double('infinity')").groupBy("row_id").agg(F.max("duration_sec").alias("d"))
    frames = rows.select(F.col("row_id").cast("string").alias("key"), F.ceil(F.col("d") * backend.frame_rate).cast("int").alias("frames"))
    scored = M.audio_frame_metrics(featurized(frames, "key", "frames", backend), "logits", "targets")
    out = M.nll_summary(scored.withColumn("model", F.lit("toy")), ["model"], F.lit(backend.frame_rate))
    return out.withColumns({"avg_nll": F.round("avg_nll", 6), "kbps": F.round("kbps", 6)})


def shard_tar_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Every vector as a sample of two frames, shuffled, written to tar shards and read again: samples and sums by shard."""
    vectors = store(table(spark, base, "embeddings").select("vec_id", "embedding", "label"), "vectors")
    placed = shuffle_split(vectors, F.col("vec_id"))
    hiddens = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    targets = F.array(F.array(F.col("label"), F.lit(1)), F.array(F.lit(40_000), F.lit(2)))
    samples = placed.select(F.format_string("%08d_%05d", "vec_id", F.lit(0)).alias("key"), hiddens.alias("hiddens"), targets.alias("targets"), F.to_json(F.struct("vec_id")).alias("meta"), "place")
    folder = f"{shared_dir(spark)}/tars-{uuid.uuid4().hex}".removeprefix("file:")
    write_tars(samples, folder, "toy_train").collect()
    read = read_tars(spark, folder)
    return read.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("meta", "$.vec_id").cast("long")).alias("id_sum"), F.max(F.col("targets")[1][0]).alias("top_id"))


QUERIES = {f.__name__: f for f in (
    slug_preview_format, prompt_lines, rope_row_permutation, key_rename, key_differences, param_counts, speed_interp, mono_mixdown, audio_chunks, text_tokens, token_table, checkpoint_scan, toy_pipeline_e2e, shard_tar_round_trip,
)}

_LAYER = ", ".join(f"('{a}', '{b}')" for a, b in C.LAYER_NAMES.items())
_OTHER = ", ".join(f"('{a}', '{b}')" for a, b in C.OTHER_NAMES.items())
_KEYS = f"SELECT a AS source, b AS target FROM (VALUES {_OTHER}) t(a, b) UNION ALL SELECT 'decoder.layers.' || i || '.' || a, 'decoder.layers.' || i || '.' || b FROM range(8) r(i), (VALUES {_LAYER}) t(a, b)"
SQL = {
    "slug_preview_format": """SELECT doc_id, regexp_replace(lower(split_part('org/' || source || ' V2!', '/', -1)), '[^a-z0-9._-]+', '-', 'g') AS slug,
        CAST(CASE WHEN length(text) <= 60 THEN length(text) ELSE 60 END AS INT) AS n_preview FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""",
    "prompt_lines": "SELECT coalesce(source, '-') AS source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents WHERE genre = 'prompt' AND text IS NOT NULL GROUP BY 1",
    "rope_row_permutation": "SELECT vec_id, vec_id // 10 * 10 + vec_id % 10 % 2 * 5 + vec_id % 10 // 2 AS target FROM embeddings",
    "key_rename": _KEYS,
    "key_differences": f"SELECT source AS key, 'missing' AS side FROM ({_KEYS}) WHERE source LIKE 'decoder.layers.6.%' OR source LIKE 'decoder.layers.7.%' UNION ALL SELECT 'decoder.extra', 'unexpected'",
    "param_counts": "SELECT label, CAST(sum(len(embedding)) AS BIGINT) AS n_values, CAST(sum(len(embedding) * 4) AS BIGINT) AS n_bytes FROM embeddings GROUP BY 1",
    "speed_interp": """WITH p AS (SELECT vec_id, embedding, i * 63 / 39::DOUBLE AS x FROM embeddings, range(40) r(i)), q AS (SELECT *, CAST(floor(x) AS INT) AS lo FROM p)
        SELECT vec_id, CAST(count(*) AS INT) AS n, round(sum(CAST(embedding[lo + 1] AS DOUBLE) * (1 - (x - lo)) + CAST(embedding[least(lo + 1, 63) + 1] AS DOUBLE) * (x - lo)), 5) AS total FROM q GROUP BY 1""",
    "mono_mixdown": "SELECT vec_id, round(max((CAST(embedding[i + 1] AS DOUBLE) + CAST(embedding[i + 33] AS DOUBLE)) / 2), 6) AS top FROM embeddings, range(32) r(i) GROUP BY 1",
    "audio_chunks": "SELECT vec_id, i // 24 AS chunk, count(*) AS n, round(sum(CAST(embedding[i + 1] AS DOUBLE)), 5) AS total FROM embeddings, range(64) r(i) GROUP BY 1, 2",
    "text_tokens": "SELECT coalesce(lower(lang), '-') AS lang, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS n_ids FROM documents GROUP BY 1",
    "token_table": "SELECT name, octet_length(encode(name)) AS n_ids, CAST(list_sum(list_transform(string_split(name, ''), lambda c: unicode(c))) AS BIGINT) AS id_sum, CAST(length(name) - 1 AS INT) AS last_pos FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region)",
    "checkpoint_scan": """SELECT key, CASE WHEN key LIKE '%q_proj%' THEN r // 4 * 4 + r % 4 % 2 * 2 + r % 4 // 2 ELSE r END AS row, CAST(1000 * k + 4 * r AS DOUBLE) AS first, CAST(1000 * k + 4 * r + 3 AS DOUBLE) AS last
        FROM (VALUES (0, 'projection.weight'), (1, 'decoder.layers.0.self_attn.q_proj.weight'), (3, 'decoder.layers.0.mlp.gate_proj.weight')) t(k, key), range(8) s(r)""",
    "shard_tar_round_trip": """WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42:' || vec_id), CAST(vec_id AS VARCHAR)) - 1 AS place FROM embeddings)
        SELECT printf('toy_train_%05d.tar', place // 250) AS shard, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS id_sum, 40000 AS top_id FROM p GROUP BY 1""",
}
