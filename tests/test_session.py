from __future__ import annotations

import pathlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from murmuro import session as S


def test_stored_and_cut_rows_are_the_same_rows(spark):
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 3 > 0, F.col("id") * 2)).repartitionByRange(4, "id")
    for kept in (S.store(df, "t"), S.cut(df)):
        assert sorted(kept.collect(), key=lambda r: r["id"]) == sorted(df.collect(), key=lambda r: r["id"])
    assert S.cut(df).rdd.glom().map(lambda rows: [r["id"] for r in rows]).collect() == df.rdd.glom().map(lambda rows: [r["id"] for r in rows]).collect()
    assert S.store(df.limit(0), "empty").count() == 0


def test_no_machine_folder_on_a_cluster(monkeypatch):
    class Nothing:
        isDefined = staticmethod(lambda: False)

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(lambda: Nothing)}))})
        getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.shared_dir(type("Session", (), {"sparkContext": Context}))


@pytest.mark.parametrize("gone", ["ahocorasick", "murmuro.llm", "murmuro.llm.catalog"])
def test_core_queries_load_without_what_the_others_need(gone):
    code = f"""
import sys, warnings
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == {gone!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Blocked())
warnings.simplefilter("ignore")
import __spark_entry__ as e
names = e.queries()
assert len(names) > 80 and not any(n.startswith(("p1_", "p2_", "p9_")) for n in names), len(names)
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=pathlib.Path(__file__).parents[1], timeout=120)
