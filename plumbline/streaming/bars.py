"""Streaming forms: watermarked bars, parsed ticks, a rolling hot window in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TICK = "instrument bigint, last_price double, last_quantity bigint, ts timestamp, last_trade_time timestamp, bids array<struct<price:double,quantity:bigint,orders:bigint>>, asks array<struct<price:double,quantity:bigint,orders:bigint>>"


def parse_ticks(raw: DataFrame, instruments: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Ticks as JSON to rows with their symbol, and those of unknown instruments. instruments: instrument, symbol.

    The time is ts, else the last trade's, else the clock's; missing depth is an empty side."""
    t = raw.select(F.from_json(value, TICK).alias("t")).select("t.*")
    t = t.withColumn("ts", F.coalesce("ts", "last_trade_time", F.current_timestamp()))
    t = t.withColumns({s: F.coalesce(s, F.array().cast(dict(t.dtypes)[s])) for s in ("bids", "asks")})
    known = t.join(instruments, "instrument", "left")
    return known.where("symbol is not null"), known.where("symbol is null").drop("symbol")


def stream_bars(trades: DataFrame, every: str, late: str) -> DataFrame:
    """Bars of a stream of trades (symbol, ts, price, qty, event_id); a bar closes when the watermark passes its end."""
    order = F.struct("ts", "event_id")
    grouped = trades.withWatermark("ts", late).groupBy("symbol", F.window("ts", every).alias("w"))
    bars = grouped.agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("qty").alias("volume"),
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def hot_window(bars: DataFrame, most: int) -> DataFrame:
    """symbol, n, last_ts, last_close after each batch: the newest bars of each symbol are kept in state, incoming win."""
    state = "ts array<timestamp>, close array<double>"

    def update(key: tuple, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        held = dict(zip(*kept.get, strict=True)) if kept.exists else {}
        for b in batches:
            held.update(zip(b["ts"], b["close"], strict=True))
        newest = sorted(held)[-most:]
        kept.update((newest, [held[t] for t in newest]))
        yield pd.DataFrame({"symbol": [key[0]], "n": [len(newest)], "last_ts": [newest[-1]], "last_close": [held[newest[-1]]]})

    return bars.groupBy("symbol").applyInPandasWithState(update, "symbol string, n long, last_ts timestamp, last_close double", state, "update", "NoTimeout")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drains what a stream has. Appended rows go to files beside the checkpoint and are read back; other modes, which
    replace rows, to a table in memory (for small results and tests)."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode != "append":
        writer.format("memory").queryName(name).start().awaitTermination()
        return stream.sparkSession.table(name)
    path = f"{checkpoint}-{name}"
    writer.format("parquet").option("path", path).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def depth_sink(snapshots: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends depth snapshots (symbol, ts, bids, asks) to a parquet table by symbol and day; of a
    batch's snapshots of one symbol and time one is written. Returns the query."""

    def write(batch: DataFrame, _: int) -> None:
        one = batch.dropDuplicates(["symbol", "ts"]).withColumn("date", F.to_date("ts"))
        one.write.mode("append").partitionBy("symbol", "date").parquet(path)

    return snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
