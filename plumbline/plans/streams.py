"""Queries of streams, drained once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import views
from ..sources.shared import shared_dir
from ..streaming.bars import run_once, stream_bars
from .catalog import BARS, query


def _checkpoint(spark) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("t01_stream_bars", f"WITH {BARS} SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)")
def bars_of_stream(spark, d):
    table = views.table(spark, d, "events")
    raw = spark.readStream.schema(table.schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    t = raw.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("qty"), "event_id",
    )
    name = f"bars_{uuid.uuid4().hex}"
    return run_once(stream_bars(t, "1 hour", "0 seconds"), name, _checkpoint(spark)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
