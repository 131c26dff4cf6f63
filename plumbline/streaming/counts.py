"""What a stream of ticks drops, and which symbols fall silent, counted while it runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bars import TICK

#: Metrics of observed() by name: rows seen, those that aren't ticks, those of unknown instruments, those without a time.
METRICS = ("seen", "malformed", "unknown", "untimed")


def observed(raw: DataFrame, instruments: DataFrame, name: str, value: str = "value") -> DataFrame:
    """symbol, instrument, last_price, last_quantity, ts of the ticks (JSON) of known instruments; the others are dropped.

    METRICS are observed under name while rows pass, so that a running query reports what it drops with every batch, without
    a pass of its own. Ticks without a time of any kind are dropped too: a clock would make reruns differ."""
    t = raw.select(F.from_json(value, TICK).alias("t")).select("t.*").withColumn("ts", F.coalesce("ts", "last_trade_time"))
    met = t.join(F.broadcast(instruments.select("instrument", "symbol").withColumn("_known", F.lit(True))), "instrument", "left")  # a list of instruments
    bad, strange = F.col("instrument").isNull(), F.col("_known").isNull()
    counted = met.observe(
        name, F.count("*").alias("seen"), F.count_if(bad).alias("malformed"), F.count_if(~bad & strange).alias("unknown"), F.count_if(~bad & ~strange & F.col("ts").isNull()).alias("untimed")
    )
    return counted.where(~bad & ~strange & F.col("ts").isNotNull()).select("symbol", "instrument", "last_price", "last_quantity", "ts")


def watched(ticks: DataFrame, late: str, silence_seconds: int) -> DataFrame:
    """symbol, rows, late, last_ts, silent of every symbol after each batch that changes it (update mode).

    late counts ticks that are older than the watermark was when their batch began. A timer in event time is set silence
    after a symbol's last tick; when the watermark passes it without another tick, the symbol is silent until one comes."""
    state = "rows long, late long, last timestamp"

    def update(key: tuple, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        rows, behind, last = kept.get if kept.exists else (0, 0, None)
        silent = kept.hasTimedOut
        mark = kept.getCurrentWatermarkMs()
        if not silent:
            for b in batches:
                ms = b["ts"].astype("int64") // 10 ** (3 if b["ts"].dtype == "datetime64[us]" else 6)
                rows, behind = rows + len(b), behind + int((ms < mark).sum())
                newest = b["ts"].max().to_pydatetime()
                last = newest if last is None else max(last, newest)
        kept.update((rows, behind, last))
        if not silent:
            kept.setTimeoutTimestamp(max(int(pd.Timestamp(last).timestamp() * 1000) + silence_seconds * 1000, mark + 1))
        yield pd.DataFrame({"symbol": [key[0]], "rows": [rows], "late": [behind], "last_ts": [last], "silent": [silent]})

    keyed = ticks.select("symbol", "ts").withWatermark("ts", late).groupBy("symbol")
    return keyed.applyInPandasWithState(update, "symbol string, rows long, late long, last_ts timestamp, silent boolean", state, "update", "EventTimeTimeout")


def metrics_of(query, name: str) -> dict[str, int]:
    """The sums of observed() over the batches that a query has run (its progress keeps the newest, 100 unless set)."""
    total = dict.fromkeys(METRICS, 0)
    for p in query.recentProgress:
        row = (p.observedMetrics or {}).get(name) if hasattr(p, "observedMetrics") else p["observedMetrics"].get(name)
        if row is not None:
            own = row.asDict() if hasattr(row, "asDict") else dict(row)
            for c in METRICS:
                total[c] += own.get(c) or 0
    return total
