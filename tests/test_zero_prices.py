"""Queries on trades at a price of zero against their SQL, which divides by it as IEEE does."""

from __future__ import annotations

import os

import duckdb
import pytest

from plumbline.plans.registry import ORACLE_SQL, QUERIES

from .compare import connect, same


@pytest.fixture(scope="module")
def zeros(sf, tmp_path_factory):
    """The tables, a fiftieth of whose events have the value zero."""
    out = tmp_path_factory.mktemp("zeros")
    for name in os.listdir(sf):
        (out / name).symlink_to(f"{sf}/{name}")
    (out / "events.parquet").unlink()
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 50 = 7 THEN 0 ELSE value END AS value) FROM '{sf}/events.parquet') TO '{out}/events.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["a04_quality_report", "p01_bad_ticks", "w04_parkinson", "r32_feature_frame"])
def test_zero_prices(spark, zeros, name):
    same(QUERIES[name](spark, zeros), connect(zeros), ORACLE_SQL[name])
