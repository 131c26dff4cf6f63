"""Queries of augmented unit-root and cointegration tests; the loops they are compared with are in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations as R
from ..operators import unit_roots as U
from ..sources import views
from .catalog import query


@query("r24_unit_roots")
def unit_roots(spark, d):
    """Log closes of every symbol and of every user's events."""
    bars = views.bars(spark, d).select("symbol", "ts", R.log_price("close").alias("x"))
    users = views.table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("symbol"), "ts", R.log_price("value").alias("x"))
    both = bars.unionByName(users)
    return U.augmented_dickey_fuller(both, "x", ["symbol"], "ts").select("symbol", "values", "lag", "n", F.round("statistic", 6).alias("statistic"), F.round("p", 6).alias("p"))


@query("k04_cointegrated_pairs")
def cointegrated_pairs(spark, d):
    """Of monthly mean closes of the nations, as few have a price on every date."""
    prices = views.panel(spark, d).groupBy(F.trunc("date", "MM").alias("date"), "symbol").agg(F.avg("close").alias("close"))
    out = U.cointegrated_pairs(prices, 10, 0.05, 0.0)
    return out.select("a", "b", "lag", *(F.round(c, 6).alias(c) for c in ("corr", "slope", "deviation", "statistic", "p")))


@query("r25_least_order")
def least_order(spark, d):
    orders = [i / 10 for i in range(11)]
    return U.least_order(views.bars(spark, d), "close", orders, 0.01).select("symbol", "d", "lag", F.round("p", 6).alias("p"))
