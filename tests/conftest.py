from __future__ import annotations

import pytest

from murmuro.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    """Small partitions that aren't merged, so what happens between partitions is tested."""
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "6", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": "/tmp/murmuro-warehouse"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def base() -> str:
    return SF
