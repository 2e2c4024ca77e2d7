"""Runs queries and their SQL side by side. python -m tests.oracle SF [NAME...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings raw_rows segments pauses shard_meta spans model_metrics layouts eval_items".split()


def connect(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{base}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x: object) -> object:
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in x)
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.number)):
        return round(float(x), 6)
    return str(x)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)


def compare(spark, con, query, sql: str, base: str) -> tuple[str, int]:
    got = query(spark, base).toPandas()
    want = con.execute(sql).fetch_df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}", len(got)
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"{len(a)} rows, {len(b)} by SQL; {sorted(set(a) ^ set(b), key=repr)[:3]}", len(a)
    for x, y in zip(a, b):
        if x != y:
            return f"{x} is {y} by SQL", len(a)
    return "", len(a)


def main() -> None:
    import __spark_entry__ as e

    from murmuro.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    base = f"/root/testdata/{sys.argv[1]}"
    con, sql = connect(base), e.oracle_sql()
    bad = 0
    for name, query in e.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        began = time.time()
        try:
            why, n = compare(spark, con, query, sql[name], base) if name in sql else ("", len(query(spark, base).collect()))
        except Exception as x:  # noqa: BLE001
            why, n = f"{type(x).__name__}: {str(x)[:1500]}", -1
        bad += bool(why)
        print(f"{'BAD ' if why else 'ok  ' if name in sql else 'rows'} {name} {n} rows {time.time() - began:.1f} s {why}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
