"""Books: weights by inverse volatility or hierarchical risk parity, caps, sizes, and costs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col

def inverse_vol(vol: str | Column = "vol") -> Column:
    """Weight in the date's book; a volatility that isn't positive has weight 0."""
    x = F.coalesce(F.try_divide(F.lit(1.0), F.when(col(vol) > 0, col(vol))), F.lit(0.0))
    return F.coalesce(F.try_divide(x, F.sum(x).over(Window.partitionBy("date"))), F.lit(0.0))


def capped(book: DataFrame, name_cap: float, sector_cap: float, weight: str = "weight") -> DataFrame:
    """Each name is cut to name_cap, then each sector is scaled to sector_cap; what is cut stays cash."""
    cut = book.withColumn("_w", F.least(weight, F.lit(name_cap)))
    total = F.sum("_w").over(Window.partitionBy("date", "sector"))
    scale = F.when(total > sector_cap, F.try_divide(F.lit(sector_cap), total)).otherwise(1.0)
    return cut.withColumn(weight, F.col("_w") * scale).drop("_w")


def vol_target(realized: Column, target: float, most: float, share: float = 1.0) -> Column:
    return F.when(realized > 0, F.least(F.try_divide(F.lit(share * target), realized), F.lit(most))).otherwise(F.lit(most))


def fill_cost(side: Column, price: Column, quantity: Column, *, rate: float = 0.0003, cap: float = 20.0, sell_tax: float = 0.00025, buy_duty: float = 0.00003, exchange: float = 0.0000297, levy: float = 0.000001, service: float = 0.18) -> Column:
    """Struct of a fill's charges. Brokerage is capped; the sale is taxed, the purchase stamped; the service tax is on
    brokerage, exchange fee and levy."""
    turnover = price * quantity
    brokerage = F.least(turnover * rate, F.lit(cap))
    tax = F.when(side == "sell", turnover * sell_tax).otherwise(0.0)
    duty = F.when(side == "buy", turnover * buy_duty).otherwise(0.0)
    fee, toll = turnover * exchange, turnover * levy
    gst = (brokerage + fee + toll) * service
    parts = {"brokerage": brokerage, "tax": tax, "duty": duty, "exchange": fee, "levy": toll, "gst": gst}
    return F.struct(*(v.alias(k) for k, v in parts.items()), sum(parts.values(), F.lit(0.0)).alias("total"))


def slippage_bps(quantity: Column, liquidity: Column, least: float, most: float) -> Column:
    """Linear in the share of liquidity that is taken, up to all of it; the most without any."""
    share = F.least(F.try_divide(quantity, liquidity), F.lit(1.0))
    return F.when(liquidity <= 0, F.lit(most)).otherwise(least + (most - least) * share)


def adverse_price(price: Column, side: Column, bps: Column) -> Column:
    return price * (1 + F.when(side == "buy", 1).otherwise(-1) * bps / 10_000)


def hierarchical_weights(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: single linkage on the correlation distance, then bisection by cluster variance."""
    n = len(cov)
    if n == 1:
        return np.ones(1)
    sd = np.sqrt(np.diag(cov))
    corr = np.clip(cov / np.outer(sd, sd), -1, 1)
    half = np.sqrt((1 - corr) / 2)
    far = np.sqrt(((half[:, None] - half[None]) ** 2).sum(-1))
    clusters = {i: [i] for i in range(n)}
    far = far + np.diag(np.full(n, np.inf))
    live = list(range(n))
    while len(live) > 1:
        sub = far[np.ix_(live, live)]
        a, b = divmod(int(sub.argmin()), len(live))
        a, b = live[min(a, b)], live[max(a, b)]
        clusters[a] = clusters[a] + clusters.pop(b)
        far[a] = far[:, a] = np.minimum(far[a], far[b])
        far[a, a] = np.inf
        live.remove(b)
    order = clusters[live[0]]
    weights = np.ones(n)
    todo = [order]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        sides = part[: len(part) // 2], part[len(part) // 2 :]
        risks = []
        for s in sides:
            inv = 1 / np.diag(cov)[s]
            inv /= inv.sum()
            risks.append(inv @ cov[np.ix_(s, s)] @ inv)
        first = 1 - risks[0] / (risks[0] + risks[1])
        weights[sides[0]] *= first
        weights[sides[1]] *= 1 - first
        todo += sides
    return weights


def hierarchical_book(covariances: DataFrame) -> DataFrame:
    """date, symbol, weight from covariances (date, a, b, cov) of every pair of a date's names, both ways and own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="a", columns="b", values="cov").sort_index().sort_index(axis=1)
        good = m.columns[np.diag(m.to_numpy()) > 0]
        m = m.loc[good, good].fillna(0.0)
        w = hierarchical_weights(m.to_numpy()) if len(m) else np.zeros(0)
        return pd.DataFrame({"date": pdf["date"].iloc[0] if len(pdf) else None, "symbol": list(m.index), "weight": w})

    return covariances.groupBy("date").applyInPandas(run, "date date, symbol string, weight double")


def scaled_by_book(book: DataFrame, returns: DataFrame, n: int, target: float, cash: str, per_year: float = 252.0) -> DataFrame:
    """date, symbol, weight of book (date, symbol, weight), scaled down to target where the book's own yearly volatility
    over the n dates to and with its date is above it; cash has the rest. returns: date, symbol, ret, on a full grid.

    Each weight meets its name's last n returns by position: an equi-join of weights times n rows."""
    w = Window.partitionBy("symbol").orderBy("date")
    placed = returns.withColumn("_at", F.row_number().over(w))
    ends = book.join(placed.select("date", "symbol", "_at"), ["date", "symbol"])
    spread = ends.select("date", "symbol", "weight", F.explode(F.sequence(F.col("_at") - (n - 1), F.col("_at"))).alias("_at"))
    met = spread.join(placed.select("symbol", "_at", F.col("date").alias("_day"), "ret"), ["symbol", "_at"])
    days = met.groupBy("date", "_day").agg(F.sum(F.col("weight") * F.col("ret")).alias("r"))
    vol = days.groupBy("date").agg((F.stddev_samp("r") * per_year**0.5).alias("_vol"))
    scaled = book.join(vol, "date", "left").withColumn("weight", F.col("weight") * F.when(F.col("_vol") > 0, F.least(F.lit(1.0), target / F.col("_vol"))).otherwise(1.0)).select("date", "symbol", "weight")
    rest = scaled.groupBy("date").agg((1 - F.sum("weight")).alias("weight")).select("date", F.lit(cash).alias("symbol"), "weight")
    return scaled.unionByName(rest)
