from __future__ import annotations

import json

from murmuro.streaming.chunks import emit_chunks, windowed_stats


def test_chunks_of_a_stream(spark, tmp_path):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    frames = spark.readStream.schema("k string, frames long, final boolean").option("maxFilesPerTrigger", 1).json(str(source))
    query = emit_chunks(frames, "k", 25).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
    try:
        for i, rows in enumerate([[("a", 20, False), ("b", 60, False)], [("a", 20, False), ("b", None, True)], [("a", 10, True), ("c", 0, True)]]):
            (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("k", "frames", "final"), r))) for r in rows))
            query.processAllAvailable()
    finally:
        query.stop()
    got = sorted((r["k"], r["chunk_no"], r["n_frames"], r["is_final"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", 0, 25, False), ("a", 1, 25, False), ("b", 0, 25, False), ("b", 1, 25, False), ("b", 2, 10, True)]


def test_windows_of_a_stream(spark, base, tmp_path):
    events = spark.read.parquet(f"{base}/events.parquet").selectExpr("cast(ts as timestamp) as ts", "event_type", "value")
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    query = windowed_stats(stream, "ts", "value", "event_type").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    try:
        query.processAllAvailable()
        assert spark.table("windows").selectExpr("sum(n)").first()[0] == events.count()
    finally:
        query.stop()
