"""Order-book snapshots: bids and asks are arrays of (price, quantity, orders), best first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio


def one_level_book(events: DataFrame) -> DataFrame:
    """A made-up book of one level for each event."""
    price = F.round("value", 2)
    level = lambda p, q: F.array(F.struct(p.alias("price"), q.cast("long").alias("quantity"), F.lit(1).cast("long").alias("orders")))
    return events.select(
        F.col("event_type").alias("symbol"), "ts", "event_id",
        level(price, 1 + F.col("event_id") % 7).alias("bids"), level(price + 0.5, 1 + F.col("event_id") % 5).alias("asks"),
    )


def flattened(book: DataFrame, levels: int = 5) -> DataFrame:
    """Price, quantity and orders of each side's levels as columns; missing levels have no price and quantity 0."""
    out = []
    for side in ("bid", "ask"):
        for i in range(levels):
            level = F.get(f"{side}s", F.lit(i))
            out += [
                level["price"].alias(f"{side}_price_{i + 1}"),
                F.coalesce(level["quantity"], F.lit(0)).alias(f"{side}_qty_{i + 1}"),
                F.coalesce(level["orders"], F.lit(0)).alias(f"{side}_orders_{i + 1}"),
            ]
    return book.select(*(c for c in book.columns if c not in ("bids", "asks")), *out)


def order_flow_imbalance(book: DataFrame, levels: int = 5) -> DataFrame:
    """Net quantity added at the bids minus the asks between snapshots, over the levels; missing at the first."""
    w = Window.partitionBy("symbol").orderBy("ts", "event_id")
    flat = flattened(book, levels)

    def moved(side: str, i: int, better: bool) -> Column:
        p, q = F.col(f"{side}_price_{i}"), F.col(f"{side}_qty_{i}")
        before, had = F.lag(p).over(w), F.lag(q).over(w)
        gains, losses = (p >= before, p <= before) if better else (p <= before, p >= before)
        return F.when(gains, q).otherwise(0) - F.when(losses, had).otherwise(0)

    total = sum((moved("bid", i, True) - moved("ask", i, False) for i in range(1, levels + 1)), F.lit(0))
    return flat.withColumn("ofi", F.when(F.row_number().over(w) > 1, total))


def spreads(book: DataFrame, levels: int = 5) -> DataFrame:
    """spread, spread_bps of the mid price, imbalance (bid minus ask quantity over both)."""
    flat = flattened(book, levels)
    bid, ask = F.col("bid_price_1"), F.col("ask_price_1")
    b, a = (sum((F.col(f"{s}_qty_{i}") for i in range(1, levels + 1)), F.lit(0)) for s in ("bid", "ask"))
    return flat.withColumns({"spread": ask - bid, "spread_bps": 10_000 * ratio(ask - bid, (ask + bid) / 2), "imbalance": ratio(b - a, b + a)})
