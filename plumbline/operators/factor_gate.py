"""From a panel of prices to the verdict on a combination of factors: scores, books, costs, active paths, gate."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rolling
from ..sources.shared import written
from . import backtest
from . import cross_section as C
from . import mechanisms as X
from . import portfolio as P
from . import validation as V

FACTORS = ("momentum", "reversal", "low_vol", "illiquidity", "residual")


@dataclass(frozen=True)
class Setup:
    """lookback, skip and window of the factors in dates; share of names in a book, names that a date needs, caps, cost of a
    trade's two sides; groups and tested groups of the cross-validation, rebalances a year; limits of the gate."""

    lookback: int = 60
    skip: int = 5
    window: int = 20
    share: float = 0.4
    least_names: int = 3
    name_cap: float = 0.4
    sector_cap: float = 0.6
    cost: float = 0.0022
    groups: int = 6
    test: int = 2
    per_year: float = 12.0
    least: dict = field(default_factory=lambda: {"median": 0.3, "deflated": 0.95, "worst": -0.5})
    most: dict = field(default_factory=lambda: {"negative": 0.4, "max_sector": 0.6})


def factor_scores(panel: DataFrame, s: Setup) -> DataFrame:
    """date, symbol, sector, close, vol and FACTORS as scores within sectors, at each month's last date; a written table.

    panel: date, symbol, sector, close, value. The market is the mean return of a date's names."""
    w = C.dated()
    p = panel.withColumn("ret", C.daily_return()).withColumn("market", F.avg("ret").over(C.on_date()))
    p = C.residual_momentum(p, s.lookback, s.skip).withColumnRenamed("residual_momentum", "residual")
    p = p.withColumns({
        "momentum": C.momentum(s.lookback, s.skip), "reversal": C.reversal(s.skip), "low_vol": C.low_volatility(s.window), "illiquidity": C.illiquidity(s.window),
        "vol": rolling(F.stddev_samp("ret"), "ret", s.window, w),
    })
    ends = p.join(C.month_ends(panel), "date", "left_semi")
    return written(ends.select("date", "symbol", "sector", "close", "vol", *(C.sector_zscore(f).alias(f) for f in FACTORS)), "factors")


def books(scores: DataFrame, combiners: dict[str, dict[str, float]], s: Setup) -> DataFrame:
    """combiner, date, symbol, sector, close, weight (0 for names that aren't held) of every combiner, factors by weight: the
    best share of names by the combined score, by inverse volatility, capped by name and sector. Names without a score or a
    positive volatility are left out, dates with fewer than least_names names have no book."""
    both = reduce(DataFrame.unionByName, (scores.withColumns({"combiner": F.lit(k), "score": C.composite(f)}) for k, f in combiners.items()))
    able = both.where("score is not null and vol > 0").withColumn("key", F.concat_ws("|", "combiner", "date"))
    able = able.withColumn("names", F.count("*").over(Window.partitionBy("key"))).where(F.col("names") >= s.least_names)
    # the book's steps go by date; a combiner's date is a date of its own
    own = able.select("combiner", F.col("date").alias("at"), F.col("key").alias("date"), "symbol", "sector", "close", "vol", "score")
    chosen = C.top_share(own, s.share).withColumn("weight", P.inverse_vol())
    held = P.capped(chosen, s.name_cap, s.sector_cap).select("combiner", F.col("at").alias("date"), "symbol", "weight")
    dates = own.select("combiner", F.col("at").alias("date")).distinct()
    grid = dates.join(scores.select("date", "symbol", "sector", "close"), "date")
    return grid.join(held, ["combiner", "date", "symbol"], "left").select("combiner", "date", "symbol", "sector", "close", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def active_returns(held: DataFrame, s: Setup) -> DataFrame:
    """combiner, start, stop, turnover, net, active of books(): from each date to the combiner's next, net of costs, active
    against the equal mean of all names with a price on both dates."""
    out = None
    for name in [r[0] for r in held.select("combiner").distinct().orderBy("combiner").collect()]:  # a row a combiner
        own = held.where(F.col("combiner") == name)
        net = backtest.rebalanced(own, s.cost).select("date", "turnover", "net").withColumn("combiner", F.lit(name))
        out = net if out is None else out.unionByName(net)
    move = held.withColumn("fwd", F.try_divide(F.lead("close").over(Window.partitionBy("combiner", "symbol").orderBy("date")), "close") - 1)
    bench = move.groupBy("combiner", "date").agg(F.avg("fwd").alias("bench"))
    nexts = bench.withColumn("stop", F.lead("date").over(Window.partitionBy("combiner").orderBy("date")))
    met = out.join(nexts, ["combiner", "date"]).where("stop is not null and bench is not null")
    return met.select("combiner", F.col("date").alias("start"), "stop", "turnover", "net", (F.col("net") - F.col("bench")).alias("active"))


def verdicts(panel: DataFrame, combiners: dict[str, dict[str, float]], s: Setup | None = None) -> DataFrame:
    """combiner, rebalances, median, worst, negative, deflated, t, turnover, max_sector, failed, passes of every combiner.

    Ratios are those of active returns on the paths of combinatorial cross-validation, a year; the deflation counts the
    combiners as trials; t has repeated events taken out. All else (universe, costs, folds, limits) is the same for all."""
    s = s or Setup()
    held = written(books(factor_scores(panel, s), combiners, s), "books")
    active = written(active_returns(held, s), "active")
    trials = V.trial_stats(active.groupBy("combiner").agg(V.sharpe("active").alias("sharpe")))
    out = None
    for name in sorted(combiners):
        own = active.where(F.col("combiner") == name).select("start", "stop", F.col("active").alias("net"))
        one = X.evaluated(own, s.groups, s.test, trials, s.per_year).withColumn("combiner", F.lit(name))
        out = one if out is None else out.unionByName(one)
    sector = held.groupBy("combiner", "date", "sector").agg(F.sum("weight").alias("w")).groupBy("combiner").agg(F.max("w").alias("max_sector"))
    turnover = active.groupBy("combiner").agg(F.avg("turnover").alias("turnover"))
    stats = out.join(sector, "combiner").join(turnover, "combiner").withColumnRenamed("events", "rebalances")
    tests = {k: F.col(k) >= v for k, v in s.least.items()} | {k: F.col(k) <= v + 1e-12 for k, v in s.most.items()}
    return V.gate(stats, tests).select("combiner", "rebalances", "median", "worst", "negative", "deflated", "t", "turnover", "max_sector", "failed", "passes")
