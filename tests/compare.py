"""Rows of a Spark query against those of its SQL on DuckDB."""

from __future__ import annotations

import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def same(df, con, sql: str) -> None:
    names = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*names).collect())
    result = con.execute(sql)
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    at = [found.index(n) for n in names]
    want = sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert len(got) == len(want)
    assert [r for r in zip(got, want, strict=True) if r[0] != r[1]][:3] == []
