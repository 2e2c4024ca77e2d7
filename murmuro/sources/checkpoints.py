"""Tensors of checkpoint files as rows: their index, a selection of them, and their names in another layout."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.sources import files

# Suffixes of a decoder layer's tensors and what they are called elsewhere.
LAYER_NAMES = {
    "attn.q_proj.weight": "self_attn.q_proj.weight",
    "attn.k_proj.weight": "self_attn.k_proj.weight",
    "attn.v_proj.weight": "self_attn.v_proj.weight",
    "attn.output_proj.weight": "self_attn.o_proj.weight",
    "mlp.w1.weight": "mlp.gate_proj.weight",
    "mlp.w2.weight": "mlp.down_proj.weight",
    "mlp.w3.weight": "mlp.up_proj.weight",
    "sa_norm.scale": "input_layernorm.weight",
    "mlp_norm.scale": "post_attention_layernorm.weight",
}
# The same of the tensors outside layers.
OTHER_NAMES = {
    "projection.weight": "projection.weight",
    "audio_embeddings.weight": "audio_embeddings.weight",
    "audio_head": "audio_head",
    "decoder.norm.scale": "decoder.norm.weight",
}
_TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}


def key_names(spark: SparkSession, layers: int = 8) -> DataFrame:
    """source and target name of every wanted tensor."""
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in LAYER_NAMES.items()])
    inner = spark.range(layers).withColumn("n", F.explode(names)).select(F.format_string("decoder.layers.%d.%s", "id", "n.a").alias("source"), F.format_string("decoder.layers.%d.%s", "id", "n.b").alias("target"))
    return spark.createDataFrame(list(OTHER_NAMES.items()), "source string, target string").unionByName(inner)


def header(path: str) -> tuple[dict, int]:
    """The description of a safetensors file, and where its data begin."""
    with files.opened(path) as f:
        (n,) = struct.unpack("<Q", f.read(8))
        return {k: v for k, v in json.loads(f.read(n)).items() if k != "__metadata__"}, 8 + n


def tensor_index(spark: SparkSession, path: str) -> DataFrame:
    """key, dtype, shape, n_values, n_bytes of every tensor, from the header alone."""
    found, _ = header(path)
    rows = [(k, v["dtype"], v["shape"], int(np.prod(v["shape"])), v["data_offsets"][1] - v["data_offsets"][0]) for k, v in found.items()]
    return spark.createDataFrame(rows, "key string, dtype string, shape array<long>, n_values long, n_bytes long")


def read_tensors(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """key, row, vector of the wanted tensors (column source), each read from its place in the file. Raises on missing ones, naming three."""
    index = tensor_index(spark, path)
    missing = wanted.join(index, wanted["source"] == index["key"], "left_anti").orderBy("source").limit(3).collect()
    if missing:
        raise KeyError(f"missing tensors: {[r['source'] for r in missing]}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, at = header(path)
        with files.opened(path) as f:
            for pdf in batches:
                for key in pdf["source"]:
                    lo, hi = found[key]["data_offsets"]
                    f.seek(at + lo)
                    data, kind = f.read(hi - lo), found[key]["dtype"]
                    values = (np.frombuffer(data, "<u2").astype("<u4") << 16).view("<f4") if kind == "BF16" else np.frombuffer(data, _TYPES[kind])
                    rows = values.reshape(found[key]["shape"][0] if found[key]["shape"] else 1, -1).astype(np.float32)
                    yield pd.DataFrame({"key": key, "row": np.arange(len(rows), dtype=np.int64), "vector": list(rows)})

    return wanted.select("source").repartition("source").mapInPandas(run, "key string, row long, vector array<float>")


def renamed(df: DataFrame, names: DataFrame, key: str = "key") -> DataFrame:
    """The wanted tensors under their target names."""
    return df.join(names, df[key] == names["source"]).drop("source", key).withColumnRenamed("target", key)


def permuted(df: DataFrame, is_rope: Column, head_dim: Column, row: str = "row") -> DataFrame:
    """Rows of query and key projections from interleaved rotary pairs to split halves. Raises on a row at or beyond n_rows, where that column is there, or where n_rows isn't a multiple of head_dim."""
    from murmuro.functions.scalars import rope_row

    if "n_rows" in df.columns:
        wrong = is_rope & ((F.col(row) >= F.col("n_rows")) | (F.pmod(F.col("n_rows"), head_dim) != 0) | (F.pmod(head_dim, F.lit(2)) != 0))
        df = df.withColumn(row, F.when(wrong, F.raise_error(F.lit("rows of a projection aren't whole heads")).cast("long")).otherwise(F.col(row)))

    return df.withColumn(row, F.when(is_rope, rope_row(F.col(row), head_dim)).otherwise(F.col(row)))


def key_differences(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Keys on one side only: key, side (missing or unexpected)."""
    both = wanted.select("key", F.lit(1).alias("w")).join(found.select("key", F.lit(1).alias("f")), "key", "full")
    return both.where("w is null or f is null").select("key", F.when(F.col("f").isNull(), "missing").otherwise("unexpected").alias("side"))
