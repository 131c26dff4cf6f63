"""The logical inputs of the operators, made from the tables at hand: trades, bars, panel, intervals, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import resample


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, price, qty, event_id"""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("qty"),
        "event_id",
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars: symbol, ts, open, high, low, close, volume."""
    return resample(trades(spark, sf_dir), "1 hour")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, symbol (nation), sector (region), close, volume, value of the days on which a symbol traded."""
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = (
        line.select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    cells = joined.groupBy(F.to_date("l_shipdate").alias("date"), F.col("n_name").alias("symbol"), F.col("r_name").alias("sector")).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.sum("l_quantity").alias("volume")
    )
    return cells.select(
        "date",
        "symbol",
        "sector",
        F.try_divide(F.col("cents") / 100.0, F.col("volume")).alias("close"),
        F.col("volume").cast("long").alias("volume"),
        (F.col("cents") / 100.0).alias("value"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y (0 or 1), p (a made-up probability)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select("doc_id", "n_chars").join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y"), ((F.pmod(F.col("n_chars"), F.lit(97)) + 1) / 100.0).alias("p")
    )
