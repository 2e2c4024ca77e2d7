"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import importlib

import pytest

import __spark_entry__ as entry

from .oracle import compare, connect

CORE = [importlib.import_module(m) for m in entry._CORE]
QUERIES = {n: q for m in CORE for n, q in m.QUERIES.items()}
SQL = {n: s for m in CORE for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def con(base):
    return connect(base)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, base, name):
    if name in SQL:
        assert compare(spark, con, QUERIES[name], SQL[name], base)[0] == ""
    else:
        QUERIES[name](spark, base).collect()


def test_entry_has_rows_and_a_stable_schema(spark):
    first, again = entry.entry(spark), entry.entry(spark)
    assert first.schema == again.schema
    assert first.count() == 7


def test_names_are_unique_and_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert sum(len(m.QUERIES) for m in CORE) == len(QUERIES)
