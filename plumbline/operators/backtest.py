"""Backtests as window and sum expressions: rebalanced books and next-open execution of target positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import series, upto
from .portfolio import fill_cost


def rebalanced(book: DataFrame, cost: float) -> DataFrame:
    """date, turnover, gross, net of a book (date, symbol, weight, close) held from each of its dates to the next.

    A name that is absent on a date has weight 0 and no return. Costs are charged on the sum of weight changes."""
    dates, symbols = book.select("date").distinct(), book.select("symbol").distinct()
    grid = dates.crossJoin(symbols).join(book.select("date", "symbol", "weight", "close"), ["date", "symbol"], "left")
    w = series("symbol", "date")
    weight = F.coalesce("weight", F.lit(0.0))
    moved = grid.select(
        "date",
        weight.alias("w"),
        (weight - F.coalesce(F.lag(weight).over(w), F.lit(0.0))).alias("dw"),
        F.coalesce(F.try_divide(F.lead("close").over(w), "close") - 1, F.lit(0.0)).alias("r"),
    )
    out = moved.groupBy("date").agg(F.sum(F.abs("dw")).alias("turnover"), F.sum(F.col("w") * F.col("r")).alias("gross"))
    return out.withColumn("net", F.col("gross") - cost * F.col("turnover"))


def holdings(bars: DataFrame, target: Column, delay: int = 1) -> DataFrame:
    """Adds held: the session's last target, delay bars later in the same session, 0 on its last bar.

    target is missing where no decision was made; a session begins flat."""
    day = F.to_date("ts")
    session = Window.partitionBy("symbol", day).orderBy("ts")
    decided = F.coalesce(F.last(target, ignorenulls=True).over(upto(session)), F.lit(0))
    with_decision = bars.withColumn("_d", decided)
    held = F.coalesce(F.lag("_d", delay).over(session), F.lit(0))
    last = F.lead("ts").over(session).isNull()
    return with_decision.withColumn("held", F.when(last, 0).otherwise(held)).drop("_d")


def equity(held: DataFrame, capital: float) -> DataFrame:
    """Adds delta, cost, cash, equity of positions (held) filled at each bar's open and marked at its close."""
    w = series()
    delta = F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0))
    moved = held.withColumn("delta", delta)
    side = F.when(F.col("delta") > 0, "buy").otherwise("sell")
    cost = F.when(F.col("delta") != 0, fill_cost(side, F.col("open"), F.abs("delta"))["total"]).otherwise(0.0)
    moved = moved.withColumn("cost", cost)
    cash = capital + F.sum(-F.col("open") * F.col("delta") - F.col("cost")).over(upto(w))
    return moved.withColumn("cash", cash).withColumn("equity", F.col("cash") + F.col("held") * F.col("close"))
