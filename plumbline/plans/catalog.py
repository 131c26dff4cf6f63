"""Registry of queries: name, Spark form, SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TRADES = """trades AS (SELECT event_type AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS qty, event_id FROM events)"""
BARS = f"""{TRADES}, bars AS (
  SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, row(ts, event_id)) AS close, CAST(sum(qty) AS BIGINT) AS volume
  FROM trades GROUP BY ALL)"""
PANEL = """panel AS (
  SELECT CAST(l_shipdate AS DATE) AS date, n_name AS symbol, r_name AS sector,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE / sum(l_quantity) AS close,
         CAST(sum(l_quantity) AS BIGINT) AS volume, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""
SCORES = "scores AS (SELECT doc_id AS id, quality AS y, (n_chars % 97 + 1) / 100.0::DOUBLE AS p FROM documents JOIN labels USING (doc_id))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def frame(n: int, by: str = "symbol", order: str = "ts") -> str:
    return f"(PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def gated(aggregate: str, x: str, n: int, order: str = "ts") -> str:
    """SQL of an aggregate over the last n rows, NULL unless all have a value."""
    return f"CASE WHEN count({x}) OVER {frame(n, order=order)} = {n} THEN {aggregate} OVER {frame(n, order=order)} END"
