"""Consolidation of very many small files into few well-sized ones.

A frozen manifest lists what is to be moved, with the row count and checksum of every file as its source
holds it; first-fit decreasing packs the files into bins; each bin is written as one file; row counts and
checksums of what was written are held against the manifest; only then is the new set published, by a
marker that only one writer can create, and one rename. A run that fails leaves the old set as it was.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuro.session import parallelism, shared_dir, store

#: Bins in a block: a block is packed by one task, so its size is bounded whatever the table's is.
BLOCK_BINS = 128
#: Bytes of names and bins up to which the list of files is broadcast; a longer one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Tasks that write bins, at most.
MOST_TASKS = 100_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; an item over capacity has a bin to itself. Ties keep their order."""
    bins = np.zeros(len(sizes), np.int64)
    free = np.zeros(0, np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        fits = np.flatnonzero(free >= sizes[i]) if sizes[i] <= capacity else ()
        if len(fits):
            at = fits[0]
            free[at] -= sizes[i]
        else:
            at = len(free)
            free = np.append(free, max(0, capacity - sizes[i]))
        bins[i] = at
    return bins


def pack_files(files: DataFrame, group: Sequence[str], name: str, size: str, target: int) -> DataFrame:
    """Adds bin (a string, unique over all groups) to files.

    files has one row per file. Files of one group never share a bin with another's. Null and
    negative sizes count as 0. The files of a group are dealt to blocks of about BLOCK_BINS bins by a
    hash of their name, and each block is packed by itself.
    """
    group = list(group)
    clean = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    totals = files.groupBy(*group).agg(F.greatest(F.lit(1), F.ceil(F.sum(clean) / (target * BLOCK_BINS))).cast("int").alias("__blocks"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"t.{c}")) for c in group]
    on = same[0]
    for c in same[1:]:
        on = on & c
    dealt = (
        files.alias("f").join(totals.alias("t"), on).select("f.*", "t.__blocks")
        .withColumn("__size", clean)
        .withColumn("__block", F.pmod(F.xxhash64(name), F.col("__blocks")).cast("int"))
        .drop("__blocks")
    )
    schema = T.StructType([*files.schema.fields, T.StructField("bin", T.StringType())])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(name, kind="stable")
        bins = first_fit_decreasing(pdf["__size"].to_numpy(np.int64), target)
        head = "-".join("none" if pd.isna(pdf[c].iloc[0]) else str(pdf[c].iloc[0]) for c in group)
        tail = f"{int(pdf['__block'].iloc[0]):06d}"
        return pdf.assign(bin=[f"{head}-{tail}-{b:05d}" for b in bins])[[f.name for f in schema.fields]]

    return dealt.groupBy(*group, "__block").applyInPandas(pack, schema)


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _holds_map(kind.elementType))


def row_hash(fields: Sequence[T.StructField]) -> F.Column:
    """A hash of a row's columns. A null counts by its place; maps are taken as JSON."""
    columns = [(F.col(f"`{f.name}`"), _holds_map(f.dataType)) for f in fields]
    nulls = [functools.reduce(lambda a, b: a + b, [F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (c, _) in enumerate(columns[at : at + 60])]) for at in range(0, len(columns), 60)]
    return F.xxhash64(*[F.to_json(F.struct(c)) if has_map else c for c, has_map in columns], *nulls)


def checksum(fields: Sequence[T.StructField]) -> F.Column:
    """The sum of row_hash, which no order of rows changes; decimals don't overflow."""
    return F.sum(row_hash(fields).cast("decimal(38,0)"))


def claim(spark: SparkSession, out: str, about: dict) -> object:
    """Creates the marker out.claim, which one writer of several can; raises FileExistsError for the others."""
    jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(f"{out}.claim")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    try:
        if fs.getScheme() == "file":  # its create looks first and creates then
            jvm.java.nio.file.Files.createFile(jvm.java.io.File(at.toUri().getPath()).toPath(), spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
            stream = fs.create(at, True)
        else:
            stream = fs.create(at, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            raise FileExistsError(f"{out}: {at} is another writer's") from None
        raise
    stream.write(bytearray(json.dumps(about).encode()))
    stream.close()
    return fs


def publish(spark: SparkSession, staged: str, out: str) -> None:
    """Makes staged the set at out; fails if there is one or another writer is at it.

    The marker out.claim decides between writers and stays; the file _PUBLISHED in the set is written
    last, for readers on stores that rename by copying.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(out)
    fs = claim(spark, out, {"staged": staged})
    marker = jvm.org.apache.hadoop.fs.Path(f"{out}.claim")
    try:
        if fs.exists(dst):
            raise FileExistsError(out)
        if not fs.rename(src, dst):
            raise OSError(f"can't rename {staged} to {out}")
    except BaseException:
        fs.delete(marker, False)
        raise
    fs.create(jvm.org.apache.hadoop.fs.Path(dst, "_PUBLISHED"), True).close()


def write_bins(rows: DataFrame, out: str, wanted: DataFrame | None = None, bins: int | None = None) -> DataFrame:
    """Writes rows, one file per value of column bin, verifies them and publishes them at out.

    wanted: bin, n (rows), s (checksum), several rows a bin if need be; made from rows if not given.
    bins: how many bins there are, about. Gives the published rows. Raises and publishes nothing if a
    bin's row count or checksum differs from what was to be written.
    """
    spark = rows.sparkSession
    data = [f for f in rows.schema.fields if f.name != "bin"]
    staged = f"{out}.staged-{uuid.uuid4().hex}"
    sums = [F.count(F.lit(1)).alias("n"), checksum(data).alias("s")]
    few = (bins or 1) <= parallelism(spark)  # then adaptive execution puts small tasks together
    (rows.repartition("bin") if few else rows.repartition(min(MOST_TASKS, bins), "bin")).write.partitionBy("bin").parquet(staged)
    read = spark.read.schema(T.StructType([*data, T.StructField("bin", T.StringType())])).parquet(staged)
    want = rows.groupBy("bin").agg(*sums) if wanted is None else wanted
    both = want.select("bin", "n", "s").unionByName(read.groupBy("bin").agg(*sums).select("bin", (-F.col("n")).alias("n"), (-F.col("s")).alias("s")))
    off = both.groupBy("bin").agg(F.sum("n").alias("missing_rows"), F.sum(F.coalesce("s", F.lit(0).cast("decimal(38,0)"))).alias("missing_sum"))
    bad = off.where("missing_rows <> 0 or missing_sum <> 0").limit(3).collect()
    if bad:
        raise ValueError(f"what was written differs from the manifest: {bad}")
    publish(spark, staged, out)
    return spark.read.schema(read.schema).parquet(out)


# ------------------------------------------------------------------ folders


def _source(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Every Parquet file below path, in folders of any depth; the listing of folders is Spark's own, by tasks where there are many."""
    return spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("mergeSchema", True).load(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """file (as rows name theirs in _metadata.file_path), n_bytes and folders (their key=value names below path) of every Parquet file below path at the time of the call; no file is opened."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    depth = at.toUri().getRawPath().rstrip("/").count("/") + 1
    files = _source(spark, path, "binaryFile").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("n_bytes"))
    # the path is a URI, in which key=value names are escaped once more; + isn't a space in either
    plain = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    folders = F.split(plain(F.regexp_replace("file", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?|/[^/]*$", "")), "/")
    named = F.filter(F.slice(folders, depth + 1, F.greatest(F.size(folders) - depth, F.lit(0))), lambda p: p.contains("="))
    value = lambda p: F.nullif(plain(F.regexp_replace(p, "^[^=]*=", "")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    return files.withColumn("folders", F.transform(named, lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("key"), value(p).alias("value"))))


def _is_key(key: str):
    return lambda p: p["key"] == key


def _with_folders(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows with a column per key of the listed files' folders (__folders): a whole number where all values are, else text."""
    whole = F.coalesce(F.col("f.value").try_cast("long").cast("string") == F.col("f.value"), F.col("f.value").isNull())
    named = listed.select(F.explode("folders").alias("f")).groupBy("f.key").agg(F.min(whole).alias("whole"))
    taken = {c.lower() for c in rows.columns}
    for key, is_whole in sorted(named.collect()):  # a row per key, not per value
        out = key
        while out.lower() in taken:
            out += "_folder"
        taken.add(out.lower())
        value = F.get(F.reverse(F.filter("__folders", _is_key(key))), F.lit(0))["value"]
        rows = rows.withColumn(out, value.cast("long") if is_whole else value)
    return rows


def compact_folder(spark: SparkSession, path: str, out: str, target: int) -> DataFrame:
    """Rewrites the Parquet files below path into files of about target bytes at out.

    Every row of the manifest's files is there exactly once, with the columns of all files together
    (null where a file lacks one; Spark raises if types can't be merged), the values of key=value folders
    as columns (under another name, key_folder, if rows have a column key) and one more column, bin.
    Files that are added meanwhile aren't in the manifest and stay out; a file that can't be read, has
    gone or has changed since makes the run raise, and nothing is published. Raises ValueError where
    there is no file, and where rows already have a column named bin.
    """
    listed = store(list_files(spark, path), "listed")
    n_files, n_chars, n_bytes = listed.agg(F.count(F.lit(1)), F.sum(F.length("file")), F.sum("n_bytes")).first()
    if not n_files:
        raise ValueError(f"no Parquet file below {path}")
    listed = F.broadcast(listed) if n_chars * 4 < BROADCAST_BYTES else listed
    source = _source(spark, path, "parquet")
    if "bin" in map(str.lower, source.columns):
        raise ValueError("a column of the rows is named bin")
    tagged = source.select(*[source[c] for c in source.columns], F.col("_metadata.file_path").alias("__file"))
    tagged = tagged.join(listed.select(F.col("file").alias("__file"), F.col("folders").alias("__folders")), "__file")
    rows = _with_folders(tagged, listed).drop("__folders")
    data = [f for f in rows.schema.fields if f.name != "__file"]
    sums = rows.groupBy(F.col("__file").alias("file")).agg(F.count(F.lit(1)).alias("n"), checksum(data).alias("s"))
    manifest = store(listed.join(sums, "file", "left").select("file", "n_bytes", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "s"), "manifest")
    _all_rows(spark, path, manifest)
    packed = store(pack_files(manifest.withColumn("folder", F.lit("all")), ["folder"], "file", "n_bytes", target).select("file", "bin", "n", "s"), "bins")
    bin_of = packed.select(F.col("file").alias("__file"), "bin")
    placed = rows.join(F.broadcast(bin_of) if n_chars * 4 < BROADCAST_BYTES else bin_of, "__file").drop("__file")
    return write_bins(placed, out, packed.where("n > 0").select("bin", "n", "s"), 2 * n_bytes // target + 1)


def _all_rows(spark: SparkSession, path: str, manifest: DataFrame) -> None:
    """Raises if a file's rows in the manifest aren't as many as its footer tells, or if rows may have been lost by their file's name."""
    opened = _source(spark, path, "parquet").select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("k"))
    both = opened.join(manifest.select("file", "n"), "file", "full")
    bad, unknown, empty = both.selectExpr("count_if(n is not null and coalesce(k, 0) <> n)", "count_if(n is null)", "count_if(n = 0)").first()
    if bad or (unknown and empty):
        raise ValueError(f"{bad} files differ from the manifest, {unknown} aren't in it, {empty} in it have no rows: list them again")


# ------------------------------------------------------------------ records of shard_meta


def model_name(model: F.Column, path: F.Column) -> F.Column:
    """The model as layouts spells it: as written without case and space, else from the file's path."""
    return F.coalesce(F.nullif(F.lower(F.trim(model)), F.lit("")), F.lower(F.get(F.split(path, "/"), F.lit(1))))


def key_part(key: F.Column, at: int) -> F.Column:
    """Row (1) or sequence (2) number in a sample key."""
    return F.nullif(F.regexp_extract(key, r"(\d+)[_-](\d+)", at), F.lit("")).cast("long")


def shard_records(meta: DataFrame) -> DataFrame:
    """shard_meta with model, row_id and seq_id made whole.

    A null row_id or seq_id comes from sample_key, a null or blank model from shard_file; where they
    hold none either, the key stays null and such rows count as one record per remaining key.
    """
    return meta.withColumns({
        "model": model_name(F.col("model"), F.col("shard_file")),
        "row_id": F.coalesce(F.col("row_id"), key_part(F.col("sample_key"), 1)),
        "seq_id": F.coalesce(F.col("seq_id"), key_part(F.col("sample_key"), 2).cast("int")),
    })


def record_manifest(meta: DataFrame) -> DataFrame:
    """One row per (model, row_id, seq_id): the copy written last, with all its columns, and the number of copies.

    Among copies of the same time the one with a cache holds, then that of the most bytes; then the
    other columns decide, so the choice doesn't depend on order. Columns n_copies and bin of an earlier
    rewrite are made anew.
    """
    key, first = ["model", "row_id", "seq_id"], ["written_at", "has_kv", "n_bytes", "audio_frames", "shard_file", "sample_key"]
    rest = [c for c in meta.columns if c not in (*key, *first, "n_copies", "bin")]
    rows = shard_records(meta)
    rank = F.struct(*[F.col(f"`{c}`") for c in (*first, *rest)])
    once = rows.groupBy(*key).agg(F.max(rank).alias("__r"), F.count(F.lit(1)).alias("n_copies"))
    kept = ["shard_file", "n_bytes", "written_at", "audio_frames", "has_kv", "sample_key", *rest]
    return once.select(*key, *[F.col("__r").getField(c).alias(c) for c in kept], "n_copies")


def plan_shards(manifest: DataFrame, target: int) -> DataFrame:
    """The manifest with the bin of each record: the bin of the file that holds its copy.

    Files keep to their model and to train or val. A file over target is taken apart, by a hash of its
    records' keys, into as many items as it holds targets.
    """
    part = F.coalesce(F.nullif(F.get(F.split("shard_file", "/"), F.lit(2)), F.lit("")), F.lit("none"))
    rows = manifest.withColumns({"__part": part, "__file": F.coalesce("shard_file", F.lit(""))})
    large = rows.groupBy("__file").agg(F.ceil(F.sum("n_bytes") / target).cast("int").alias("__parts")).where("__parts > 1")
    piece = F.coalesce(F.pmod(F.xxhash64("row_id", "seq_id"), F.col("__parts")), F.lit(0))
    rows = rows.join(large, "__file", "left").withColumn("__item", F.concat_ws("#", "__file", piece)).drop("__parts", "__file")
    items = rows.groupBy("model", "__part", "__item").agg(F.sum("n_bytes").alias("n_bytes"))
    packed = pack_files(items, ["model", "__part"], "__item", "n_bytes", target).select("model", "__item", "bin")
    m, p = rows.alias("m"), packed.alias("p")
    same = F.col("m.model").eqNullSafe(F.col("p.model")) & (F.col("m.__item") == F.col("p.__item"))
    return m.join(p, same).select(*[f"m.`{c}`" for c in manifest.columns], "p.bin")


def compact_records(meta: DataFrame, target: int, out: str | None = None) -> DataFrame:
    """shard_meta rewritten: each record once, with all columns of its last copy, in bins of about target n_bytes. Gives the published rows.

    The manifest has a hash of each record, as it was found, and the new files' rows are held against those.
    """
    spark = meta.sparkSession
    records = record_manifest(meta)
    manifest = store(records.withColumn("__sum", row_hash(records.schema.fields)), "manifest")
    plan = store(plan_shards(manifest, target), "plan")
    sums = plan.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__sum").cast("decimal(38,0)")).alias("s"))
    return write_bins(plan.drop("__sum"), out or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", sums)
