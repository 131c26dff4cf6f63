"""Operators across symbols on a date, price factors along dates, and universes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import col, rank_share, ratio, rolling, rolling_quantile, series, upto, zscore

def on_date() -> WindowSpec:
    """All symbols of a date."""
    return Window.partitionBy("date")


def dated() -> WindowSpec:
    """A symbol's rows by date."""
    return series("symbol", "date")


def centred_rank(x: str | Column) -> Column:
    """Average-tie rank over the number of values, minus one half."""
    return rank_share(x, on_date()) - 0.5


def attached(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Adds to panel (date, symbol, sector) for every column its centred rank among its date's names (x_rank) and its score among
    those of its sector (x_z). All columns share the two groupings, so there is one shuffle by date."""
    return panel.withColumns({f"{c}_rank": centred_rank(c) for c in columns} | {f"{c}_z": sector_zscore(c) for c in columns})


def sector_zscore(x: str | Column) -> Column:
    """Score against the date's sector; missing in a sector of one name or without spread."""
    w = Window.partitionBy("date", "sector")
    return zscore(col(x), F.avg(col(x)).over(w), F.stddev_samp(col(x)).over(w))


def bucket(x: str | Column, n: int = 10) -> Column:
    """0 .. n - 1 by the rank share; not ntile, as ties stay together."""
    share = rank_share(x, on_date())
    return F.when(share.isNotNull(), F.least(F.greatest(F.ceil(F.round(share * n, 9)) - 1, F.lit(0)), F.lit(n - 1)).cast("int"))


def composite(factors: dict[str, float]) -> Column:
    """Weighted mean of the factors that are present, by absolute weight."""
    top = sum((F.coalesce(F.col(f) * w, F.lit(0.0)) for f, w in factors.items()), F.lit(0.0))
    held = sum((F.when(F.col(f).isNotNull(), abs(w)).otherwise(0.0) for f, w in factors.items()), F.lit(0.0))
    return F.try_divide(top, F.when(held > 0, held))


def dense(panel: DataFrame, values: tuple[str, ...] = ("close", "volume", "value")) -> DataFrame:
    """Every symbol on every date; untraded cells are missing. Offsets then count the calendar's rows."""
    dates, symbols = panel.select("date").distinct(), panel.select("symbol", "sector").distinct()
    return dates.crossJoin(symbols).join(panel.select("date", "symbol", *values), ["date", "symbol"], "left")


def momentum(lookback: int, skip: int) -> Column:
    return F.try_divide(F.lag("close", skip).over(dated()), F.lag("close", lookback).over(dated())) - 1


def reversal(n: int) -> Column:
    return -(F.try_divide("close", F.lag("close", n).over(dated())) - 1)


def daily_return() -> Column:
    return F.try_divide("close", F.lag("close").over(dated())) - 1


def low_volatility(n: int, ret: str = "ret") -> Column:
    return -rolling(F.stddev_samp(ret), ret, n, dated())


def illiquidity(n: int, ret: str = "ret") -> Column:
    x = F.try_divide(F.abs(ret), F.when(F.col("value") > 0, F.col("value")))
    return rolling(F.avg(x), x, n, dated())


def residual_momentum(panel: DataFrame, n: int, skip: int) -> DataFrame:
    """Sum of returns beyond a market model that is fitted on the n returns before; shifted by skip.

    panel: date, symbol, ret, market."""
    pair = F.when(F.col("ret").isNotNull() & F.col("market").isNotNull(), F.col("ret"))
    fit = panel.withColumn("_y", pair).withColumn("_x", F.when(F.col("_y").isNotNull(), F.col("market")))
    slope = F.try_divide(rolling(F.covar_samp("_y", "_x"), "_y", n, dated()), rolling(F.var_samp("_x"), "_x", n, dated()))
    fit = fit.withColumn("_b", slope).withColumn("_a", rolling(F.avg("_y"), "_y", n, dated()) - F.col("_b") * rolling(F.avg("_x"), "_x", n, dated()))
    left = F.col("_y") - (F.lag("_a").over(dated()) + F.lag("_b").over(dated()) * F.col("_x"))
    fit = fit.withColumn("_e", left)
    m = n - skip
    total = fit.withColumn("_s", rolling(F.sum("_e"), "_e", m, dated()))
    return total.withColumn("residual_momentum", F.lag("_s", skip).over(dated())).drop("_y", "_x", "_a", "_b", "_e", "_s")


def average_daily_value(n: int) -> Column:
    """Trailing median of value; half a window is enough."""
    return rolling_quantile("value", 0.5, n, dated(), least=max(1, n // 2))


def liquidity_universe(panel: DataFrame, n: int, window: int, seasoned: int) -> DataFrame:
    """On each month's last date, the n symbols of largest trailing value that traded on seasoned dates or more."""
    with_adv = panel.withColumns({"adv": average_daily_value(window), "traded": F.count("close").over(upto(dated()))})
    ends = month_ends(panel)
    able = with_adv.join(ends, "date", "left_semi").where(F.col("adv").isNotNull() & (F.col("traded") >= seasoned))
    place = F.row_number().over(on_date().orderBy(F.desc("adv"), "symbol"))
    return able.withColumn("place", place).where(F.col("place") <= n)


def month_ends(panel: DataFrame, date: str = "date") -> DataFrame:
    return panel.groupBy(F.trunc(date, "MM").alias("month")).agg(F.max(date).alias(date)).select(date)


def forward_return(n: int) -> Column:
    return F.try_divide(F.lead("close", n).over(dated()), "close") - 1


def top_share(scores: DataFrame, share: float, score: str = "score") -> DataFrame:
    """On each date the round(share * n) names of largest score, one at least, ties by symbol; half rounds to even."""
    n = F.count(score).over(on_date())
    place = F.row_number().over(on_date().orderBy(F.desc_nulls_last(score), "symbol"))
    return scores.where(F.col(score).isNotNull()).withColumns({"_n": n, "_p": place}).where(F.col("_p") <= F.greatest(F.lit(1), F.bround(F.col("_n") * share))).drop("_n", "_p")


def split_adjusted(panel: DataFrame, events: DataFrame, most: float = 0.98) -> DataFrame:
    """Prices before a date in events (date, symbol) are scaled by the ratio of closes across it, if in (0, most)."""
    marked = panel.join(events.select("date", "symbol").distinct().withColumn("_event", F.lit(True)), ["date", "symbol"], "left")
    step = F.try_divide("close", F.lag("close").over(dated()))
    marked = marked.withColumn("_f", F.when(F.col("_event") & (step > 0) & (step < most), step).otherwise(1.0))
    later = dated().rowsBetween(1, Window.unboundedFollowing)
    scale = F.coalesce(F.product("_f").over(later), F.lit(1.0))
    return marked.withColumns({"adj_close": F.col("close") * scale, "adj_volume": ratio("volume", scale)}).drop("_event", "_f")


#: Names of a block of a correlation matrix, and dates whose products one task adds up.
NAMES, DAYS = 512, 64


def correlations(returns: DataFrame) -> DataFrame:
    """a, b, n, corr of every two names (a before b) that share two dates or more, over the dates that both have.
    returns: date, symbol, ret.

    Names are dealt into blocks of about NAMES; a task takes two blocks over DAYS dates as two matrices and adds up their
    products, so that what is shuffled is rows times blocks and sums of pairs, not pairs times dates."""
    import numpy as np
    import pandas as pd

    held = returns.where("ret is not null").select("date", "symbol", F.col("ret").cast("double").alias("ret"))
    blocks = -(-(held.select("symbol").distinct().count() or 1) // NAMES)
    own = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    dealt = held.withColumns({"own": own, "part": F.floor(F.unix_date("date") / DAYS)}).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"i": F.least("own", "other").cast("int"), "j": F.greatest("own", "other").cast("int")})

    def sums(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        days = {d: k for k, d in enumerate(sorted(p["date"].unique()))}
        sides = []
        for block in (key[1], key[2]):
            q = p[p["own"] == block]
            names = np.array(sorted(q["symbol"].unique()), object)
            x, m = np.zeros((len(days), len(names))), np.zeros((len(days), len(names)))
            at = q["date"].map(days).to_numpy(), np.searchsorted(names, q["symbol"].to_numpy(object))
            x[at], m[at] = q["ret"].to_numpy(), 1.0
            sides.append((names, x, m))
        (na, xa, ma), (nb, xb, mb) = sides
        n = ma.T @ mb
        a, b = np.nonzero((n > 0) & (na[:, None] != nb[None]))
        if key[1] == key[2]:
            a, b = a[na[a] < nb[b]], b[na[a] < nb[b]]
        stats = [n, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb), xa.T @ xb]
        return pd.DataFrame({"a": na[a], "b": nb[b]} | {c: s[a, b] for c, s in zip(("n", "sa", "sb", "saa", "sbb", "sab"), stats, strict=True)})

    found = dealt.groupBy("part", "i", "j").applyInPandas(sums, "a string, b string, n double, sa double, sb double, saa double, sbb double, sab double")
    # names of different blocks come in the blocks' order: put them in their own
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    put = found.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), "n", pick("sa", "sb").alias("sa"), pick("sb", "sa").alias("sb"), pick("saa", "sbb").alias("saa"), pick("sbb", "saa").alias("sbb"), "sab")
    g = put.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")))
    va, vb = F.col("n") * F.col("saa") - F.col("sa") * F.col("sa"), F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb")
    corr = F.try_divide(F.col("n") * F.col("sab") - F.col("sa") * F.col("sb"), F.sqrt(F.when((va > 0) & (vb > 0), va * vb)))
    return g.where("n > 1").select("a", "b", F.col("n").cast("long").alias("n"), corr.alias("corr"))
