"""Every query for training data on the smallest tables, against SQL where there is some."""

from __future__ import annotations

import pytest

from murmuro.llm.catalog import QUERIES, SQL
from tests.oracle import compare, connect

COLUMNS = {
    "p2_found": {"source_dataset_id", "first_segment_id", "last_segment_id"}, "p3_found": {"row_id", "group_row_id"}, "p5_found": {"model", "row_id", "seq_id"}, "p8_ids": {"doc_id", "ids"},
    "p9_found": {"doc_id", "item_id"}, "p10_found": {"doc_id_a", "doc_id_b"},
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, base, name):
    if name in SQL and name not in ("p3_shares", "p4_fill"):  # shares of a few groups are coarse
        assert compare(spark, connect(base), QUERIES[name], SQL[name], base)[0] == ""
    else:
        rows = QUERIES[name](spark, base)
        assert set(rows.columns) >= COLUMNS.get(name, set()) and (name not in COLUMNS or set(rows.columns) == COLUMNS[name])
        assert rows.count() >= 0


@pytest.mark.parametrize("name", ["p3_shares", "p4_fill"])
def test_shares_and_fill_on_more_rows(spark, name):
    base = "/root/testdata/sf0.01"
    assert compare(spark, connect(base), QUERIES[name], SQL[name], base)[0] == ""
