from __future__ import annotations

import datetime
import glob
import os

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from murmuro.operators import compaction as C

META = "shard_file string, sample_key string, row_id long, seq_id int, audio_frames int, model string, has_kv boolean, n_bytes long, written_at timestamp"
T0 = datetime.datetime(2025, 1, 1)


@given(st.lists(st.integers(0, 120), max_size=60), st.integers(1, 100))
def test_first_fit_decreasing_keeps_to_capacity(sizes, capacity):
    sizes = np.array(sizes, np.int64)
    bins = C.first_fit_decreasing(sizes, capacity)
    for b in set(bins.tolist()):
        inside = sizes[bins == b]
        assert inside.sum() <= capacity or len(inside[inside > 0]) == 1
    used = len(set(bins.tolist()))
    assert used <= 2 * max(1, -(-int(np.minimum(sizes, capacity).sum()) // capacity)) + (1 if len(sizes) else 0)


def row(file, key, row_id, seq, model, n_bytes, minutes, frames=10):
    return (file, key, row_id, seq, frames, model, False, n_bytes, None if minutes is None else T0 + datetime.timedelta(minutes=minutes))


@pytest.fixture
def meta(spark):
    rows = [row(f"shards/miso/train/d/{i:05d}.tar", f"{i:08d}_00000", i, 0, "miso", 100 + i, i) for i in range(40)]
    rows += [row("shards/miso/train/d/x.tar", "retry/00000003-00000", None, None, " MISO", 7, 99), row("shards/miso/train/d/y.tar", "./00000004_00000", 4, 0, None, 8, None)]
    rows += [row("shards/fish/val/d/z.tar", None, None, None, "", None, 1), row(None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, META)


def test_each_record_once_latest_copy_in_one_bin(spark, meta, tmp_path):
    out = C.compact_records(meta, 1000, f"{tmp_path}/out").collect()
    keys = [(r["model"], r["row_id"], r["seq_id"]) for r in out]
    assert len(keys) == len(set(keys)) == 42
    by = {k: r for k, r in zip(keys, out)}
    assert by["miso", 3, 0]["n_bytes"] == 7 and by["miso", 3, 0]["n_copies"] == 2
    assert by["miso", 4, 0]["n_bytes"] == 104 and by["miso", 4, 0]["n_copies"] == 2
    assert by["fish", None, None]["n_copies"] == 1
    sizes: dict = {}
    for r in out:
        sizes[r["bin"]] = sizes.get(r["bin"], 0) + (r["n_bytes"] or 0)
    assert max(sizes.values()) <= 1000
    files = glob.glob(f"{tmp_path}/out/bin=*/*.parquet")
    assert len(files) == len(sizes)


def test_the_new_set_has_all_columns_of_the_last_copy(spark, meta, tmp_path):
    more = meta.withColumns({
        "source_dataset_id": F.coalesce("row_id", F.lit(-1)) + 500, "segment_id": F.coalesce("n_bytes", F.lit(0)).cast("int"), "frame_rate": F.lit(12.5), "hidden_dim": F.when(F.col("n_bytes") != 7, 4096),
        "num_codebooks": F.lit(32), "part": F.lit("p"), "n": F.lit(9), "s": F.lit("s"), "r": F.array(F.lit(1)), "a.b": F.lit("dot"),
    })
    out = C.compact_records(more, 1000, f"{tmp_path}/out")
    assert set(out.columns) == {*more.columns, "n_copies", "bin"}
    by = {(r["model"], r["row_id"], r["seq_id"]): r.asDict() for r in out.collect()}
    last = {"sample_key": "retry/00000003-00000", "source_dataset_id": 499, "segment_id": 7, "frame_rate": 12.5, "hidden_dim": None, "num_codebooks": 32, "part": "p", "n": 9, "s": "s", "r": [1], "a.b": "dot", "n_copies": 2}
    assert {c: by["miso", 3, 0][c] for c in last} == last
    assert by["miso", 5, 0]["sample_key"] == "00000005_00000" and by["miso", 5, 0]["source_dataset_id"] == 505 and by["miso", 5, 0]["hidden_dim"] == 4096
    again = C.compact_records(out, 1000, f"{tmp_path}/again")
    assert sorted(again.columns) == sorted(out.columns) and again.count() == len(by)


def test_a_change_of_any_column_is_seen(spark, meta, tmp_path, monkeypatch):
    rows = C.plan_shards(C.record_manifest(meta.withColumn("frame_rate", F.lit(12.5))), 1000)
    whole = DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, path: whole(self, path).withColumn("frame_rate", F.lit(21.0)))
    with pytest.raises(ValueError, match="differs"):
        C.write_bins(rows, f"{tmp_path}/out")


def test_a_file_over_the_target_is_taken_apart(spark, tmp_path):
    rows = [row("shards/miso/train/d/huge.tar", f"{i:08d}_00000", i, 0, "miso", 100, i) for i in range(100)]
    out = C.compact_records(spark.createDataFrame(rows, META), 1000, f"{tmp_path}/out")
    sizes = [r["sum(n_bytes)"] for r in out.groupBy("bin").sum("n_bytes").collect()]
    assert out.count() == 100 and len(sizes) >= 8 and max(sizes) <= 2000


def test_nothing_is_published_if_a_bin_differs(spark, meta, tmp_path, monkeypatch):
    rows = C.plan_shards(C.record_manifest(meta), 1000)
    whole = DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, path: whole(self, path).withColumn("n_bytes", F.when(F.col("row_id") == 5, 1).otherwise(F.col("n_bytes"))))
    with pytest.raises(ValueError, match="differs"):
        C.write_bins(rows, f"{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out")


def test_a_second_set_doesnt_replace_the_first(spark, meta, tmp_path):
    C.compact_records(meta, 1000, f"{tmp_path}/out")
    with pytest.raises(FileExistsError):
        C.compact_records(meta, 1000, f"{tmp_path}/out")


def test_folder_of_small_files(spark, tmp_path):
    spark.range(500).withColumn("x", F.when(F.col("id") % 7 > 0, F.concat(F.lit("v"), "id"))).repartition(60).write.parquet(f"{tmp_path}/in")
    out = C.compact_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out", 10_000)
    assert sorted((r["id"], r["x"]) for r in out.select("id", "x").collect()) == sorted((i, f"v{i}" if i % 7 else None) for i in range(500)) or out.count() == 500
    assert out.select("id").distinct().count() == 500
    assert len(glob.glob(f"{tmp_path}/out/bin=*/*.parquet")) < 10


def test_empty_and_clashing_columns(spark, meta, tmp_path):
    assert C.compact_records(spark.createDataFrame([], META), 1000, f"{tmp_path}/empty").count() == 0
    wide = meta.withColumns({c: F.lit("x") for c in ("bin", "r", "n", "s", "file", "part", "__size", "__block", "n_copies")})
    assert C.compact_records(wide, 1000, f"{tmp_path}/wide").count() == 42


def files_of(folder):
    return {f for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def test_names_with_blanks_and_percent_signs_keep_their_rows(spark, tmp_path):
    for k, name in enumerate(["a", "b c", "d%e", "k=1", "f+g", "h%20i", "j#k", "l=m n%2F"]):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    out = C.compact_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out", 1 << 20)
    rows = {r["id"]: r for r in out.collect()}
    assert sorted(rows) == list(range(80)) and out.count() == 80
    assert rows[31]["k"] == 1 and rows[0]["k"] is None and rows[75]["l"] == "m n/"


def test_single_files_with_odd_names(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in/x y")
    for k, name in enumerate(["a.parquet", "b c.parquet", "x y/d%e.parquet", "x y/k=1 100%.parquet"]):
        pd.DataFrame({"id": range(k * 10, k * 10 + 10)}).to_parquet(f"{tmp_path}/in/{name}")
    out = C.compact_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out", 1 << 20)
    assert sorted(r["id"] for r in out.collect()) == list(range(40)) and len(files_of(f"{tmp_path}/out")) == 1


def test_columns_of_all_files_are_kept(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    spark.range(10, 20).withColumn("extra", F.lit("e")).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    out = C.compact_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out", 1 << 20)
    assert set(out.columns) == {"id", "extra", "bin"}
    assert {r["id"]: r["extra"] for r in out.collect()} == {i: "e" if i >= 10 else None for i in range(20)}


def test_types_that_cant_be_merged_raise(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in/1")
    spark.range(10).select(F.col("id").cast("string")).write.parquet(f"{tmp_path}/in/2")
    with pytest.raises(Exception, match="(?i)merge"):
        C.compact_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out", 1 << 20)
    assert not os.path.exists(f"{tmp_path}/out")


def test_folder_values_null_typed_and_clashing(spark, tmp_path):
    df = spark.createDataFrame([(1, 10, "a b"), (2, None, "c%d"), (3, 30, None)], "id long, n int, s string")
    df.write.partitionBy("n", "s").parquet(f"{tmp_path}/in/p=2024")
    df.select("id", F.lit("own").alias("p")).coalesce(1).write.parquet(f"{tmp_path}/in/p=x")
    out = C.compact_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out", 1 << 20)
    got = sorted(((r["id"], r["n"], r["s"], r["p"], r["p_folder"]) for r in out.collect()), key=str)
    want = [(1, 10, "a b", None, "2024"), (2, None, "c%d", None, "2024"), (3, 30, None, None, "2024"), *[(i, None, None, "own", "x") for i in (1, 2, 3)]]
    assert got == sorted(want, key=str)


def test_a_folder_above_is_no_column(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/day=7/in")
    assert set(C.compact_folder(spark, f"{tmp_path}/day=7/in", f"{tmp_path}/out", 1 << 20).columns) == {"id", "bin"}


def test_empty_files_and_maps_and_repeated_rows(spark, tmp_path):
    spark.range(0).withColumn("m", F.lit(None).cast("map<string,int>")).write.parquet(f"{tmp_path}/in/1")
    spark.range(4).withColumn("m", F.create_map(F.lit("a"), F.col("id").cast("int"))).unionAll(spark.range(4).withColumn("m", F.lit(None).cast("map<string,int>"))).write.parquet(f"{tmp_path}/in/2")
    out = C.compact_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out", 1 << 20)
    assert out.count() == 8 and out.where("m is null").count() == 4
    with pytest.raises(ValueError, match="no Parquet"):
        os.makedirs(f"{tmp_path}/none")
        C.compact_folder(spark, f"{tmp_path}/none", f"{tmp_path}/out2", 1 << 20)


def test_a_manifest_that_lost_a_file_raises(spark, tmp_path, monkeypatch):
    spark.range(100).repartition(5).write.parquet(f"{tmp_path}/in")
    one = sorted(files_of(f"{tmp_path}/in"))[0]
    whole = C.list_files
    monkeypatch.setattr(C, "list_files", lambda s, p: whole(s, p).withColumn("file", F.when(F.col("file").endswith(os.path.basename(one)), F.concat("file", F.lit("%20"))).otherwise(F.col("file"))))
    with pytest.raises(ValueError, match="list them again"):
        C.compact_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out", 1 << 20)
    assert not os.path.exists(f"{tmp_path}/out")


def test_the_long_list_of_files_is_joined(spark, tmp_path, monkeypatch):
    spark.range(100).withColumn("k", F.col("id") % 7).write.partitionBy("k").parquet(f"{tmp_path}/in")
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    out = C.compact_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out", 2000)
    assert sorted((r["id"], r["k"]) for r in out.collect()) == [(i, i % 7) for i in range(100)]


def test_checksum_sees_columns_change_places(spark):
    df = spark.createDataFrame([("a", None), (None, "b")], "x string, y string")
    sums = [d.agg(C.checksum(d.schema.fields)).first()[0] for d in (df, spark.createDataFrame([(None, "a"), ("b", None)], "x string, y string"))]
    assert sums[0] != sums[1]


def test_of_two_writers_one_publishes(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    for k in range(4):
        os.makedirs(f"{tmp_path}/staged{k}")
        (tmp_path / f"staged{k}" / "f").write_text(str(k))

    def one(k):
        try:
            C.publish(spark, f"{tmp_path}/staged{k}", f"{tmp_path}/out")
            return k
        except FileExistsError:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [k for k in pool.map(one, range(4)) if k is not None]
    assert len(won) == 1 and (tmp_path / "out" / "f").read_text() == str(won[0]) and sorted(os.listdir(tmp_path / "out"))[-2:] == ["_PUBLISHED", "f"]
    assert sum(os.path.exists(f"{tmp_path}/staged{k}") for k in range(4)) == 3
