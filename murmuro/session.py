"""Session settings and the shared folder for cut lineage.

Everything that is written between stages goes to the folder the cluster names in
``spark.checkpoint.dir``; it survives the loss of an executor. A folder of our own is made only
where the setting is missing and the session runs in one process, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "murmuro", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; what is in it is deleted when the application ends.

    Raises on a cluster that names no folder: a machine's own won't do there.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return _kept(spark, found.get())
    path = context.getConf().get("spark.checkpoint.dir")
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set; name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="murmuro-")
    context.setCheckpointDir(path)
    return _kept(spark, context._jsc.sc().getCheckpointDir().get())


_known: set[str] = set()


def _kept(spark: SparkSession, path: str) -> str:
    if path not in _known:
        _known.add(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions and order, read from the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder; for what is read more than once by column."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")



__all__ = ["build_session", "cut", "parallelism", "shared_dir", "store", "table"]
