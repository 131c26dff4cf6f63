"""Every query of the library against its SQL; those without SQL must run and have a schema."""

from __future__ import annotations

import pytest

from plumbline.plans.registry import ORACLE_SQL, QUERIES

from .compare import connect, same


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE_SQL:
        same(df, con, ORACLE_SQL[name])
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
