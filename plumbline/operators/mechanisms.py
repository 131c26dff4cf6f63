"""Rule-based strategies of dated events, judged by combinatorial cross-validation; evidence of a panel of configurations;
a battery of robustness checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import validation as V
from .events import shuffled_drawdowns
from .joins import as_of


class TimelineError(ValueError):
    """Events that a cross-validation by time can't be made of."""


def checked_timeline(events: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """The events, if each has a start and a stop not before it and no two share a start; else an error that says how many
    don't. Costs an aggregate."""
    bad = events.agg(
        F.count_if(F.col(start).isNull() | F.col(stop).isNull()).alias("open"), F.count_if(F.col(stop) < F.col(start)).alias("reversed"),
        (F.count(start) - F.count_distinct(start)).alias("repeated"),
    ).first()  # fmt: skip  one row
    wrong = {k: v for k, v in bad.asDict().items() if v}
    if wrong:
        raise TimelineError(", ".join(f"{v} {k}" for k, v in wrong.items()))
    return events


def review_returns(reviews: DataFrame, panel: DataFrame, cost: float) -> DataFrame:
    """review, start, stop, legs, net of every review (review, announced, effective, adds, deletes: arrays of symbols).

    Equal weights, long what is added and short what is deleted, from the first date of the panel (date, symbol, close) at or
    after the announcement to the first at or after the effective date; net is the mean signed return less cost. Names
    without a positive price on the first or any on the second date are left out; a review without a name or without a
    later second date has no row."""
    # a calendar and a list of reviews: some thousands of rows
    days = panel.select(F.col("date").alias("ts"), F.col("date").alias("day"), F.lit(0).alias("_k")).distinct()
    held = reviews.withColumn("_k", F.lit(0))
    held = as_of(held.withColumn("ts", F.col("announced")), days, by=("_k",), values=("day",), forward=True).withColumnRenamed("day", "start")
    held = as_of(held.withColumn("ts", F.col("effective")), days, by=("_k",), values=("day",), forward=True).withColumnRenamed("day", "stop")
    held = held.where("stop > start").select("review", "start", "stop", "adds", "deletes")

    def side(names: str, sign: float) -> Column:
        known = F.coalesce(names, F.array().cast("array<string>"))
        return F.transform(known, lambda s: F.struct(s.alias("symbol"), F.lit(sign).alias("sign")))

    sides = F.concat(side("adds", 1.0), side("deletes", -1.0))
    legs = held.select("review", "start", "stop", F.explode(sides).alias("l")).select("review", "start", "stop", "l.*")
    enter = panel.select("symbol", F.col("date").alias("start"), F.col("close").alias("_a"))
    leave = panel.select("symbol", F.col("date").alias("stop"), F.col("close").alias("_b"))
    met = legs.join(enter, ["symbol", "start"]).join(leave, ["symbol", "stop"]).where("_a > 0 and _b is not null")
    each = met.groupBy("review", "start", "stop").agg(F.count("*").alias("legs"), F.avg(F.col("sign") * (F.col("_b") / F.col("_a") - 1)).alias("_g"))
    return each.select("review", "start", "stop", "legs", (F.col("_g") - cost).alias("net"))


def evaluated(events: DataFrame, groups: int, test: int, trials: DataFrame, per_year: float | None = None) -> DataFrame:
    """One row on the net returns of a rule's events (start, stop, net), whose timeline is checked: events, per_year (by the
    calendar time from the first to the last start, 2 if that is nothing), median, worst and negative share of the paths' Sharpe
    ratios a year, deflated ratio of all events at trials (trials, variance: one row), and the t statistic of the paths
    with repeats taken out."""
    held = written(checked_timeline(events).select("start", "stop", "net"), "events")
    paths = written(V.combinatorial_results(held, groups, test, ["start"]).select("path", F.col("net").alias("ret")), "paths")
    span = F.datediff(F.max("start"), F.min("start")) / 365.25
    year = F.lit(float(per_year)) if per_year else F.when(span > 0, F.count("*") / span).otherwise(2.0)
    own = held.agg(F.count("*").alias("events"), year.alias("per_year"))
    found = V.path_distribution(paths).join(F.broadcast(own)).join(F.broadcast(V.moments(held, "net"))).join(F.broadcast(trials)).join(F.broadcast(V.deduplicated(paths, "ret").select("t")))  # one row each
    root = F.sqrt("per_year")
    dsr = V.deflated_sharpe_of(*(F.col(c) for c in ("sharpe", "n", "skew", "kurtosis", "variance", "trials")))
    return found.select("events", "per_year", (F.col("median") * root).alias("median"), (F.col("worst") * root).alias("worst"), "negative", "paths", dsr.alias("deflated"), "t")


def panel_evidence(returns: DataFrame, partitions: int) -> DataFrame:
    """One row on a panel of configurations (strategy, part, ret; part: 0 .. partitions - 1): trials, variance of their ratios,
    best (ties by name), its ratio, its ratio deflated by trials and variance, and the probability that the choice of the
    best is overfitted."""
    per = V.moments(returns, "ret", ("strategy",))
    best = per.agg(F.max(F.struct("sharpe", "strategy"))["strategy"].alias("strategy"))  # one row
    top = per.join(F.broadcast(best), "strategy").join(F.broadcast(V.trial_stats(per)))
    dsr = V.deflated_sharpe_of(*(F.col(c) for c in ("sharpe", "n", "skew", "kurtosis", "variance", "trials")))
    pbo = V.overfitting_probability(returns, partitions).agg(F.avg((F.col("logit") <= 0).cast("int")).alias("pbo"))
    return top.select("trials", "variance", F.col("strategy").alias("best"), "sharpe", dsr.alias("deflated")).join(F.broadcast(pbo))


def shuffled_control(prices: DataFrame, strategy, seeds: int, by: str = "symbol", order: str = "ts", x: str = "ret") -> DataFrame:
    """seed, by, gain: what strategy, a column over the returns x before a row (in window order), earns a row in the mean on
    every name's returns in seeds random orders. Order is all that a shuffle takes from the returns, so a strategy that
    looks ahead, or an evaluation that does, earns on them too.

    prices: by, order, x. An order follows from a hash of seed, name and row, so that reruns agree."""
    many = prices.where(F.col(x).isNotNull()).select(by, order, x).crossJoin(F.broadcast(prices.sparkSession.range(seeds).select(F.col("id").alias("seed"))))  # seeds rows
    w = Window.partitionBy("seed", by).orderBy(F.xxhash64("seed", by, order), order)
    gain = many.withColumn("_g", strategy(w) * F.col(x))
    return gain.groupBy("seed", by).agg(F.avg("_g").alias("gain"))


def battery(results: DataFrame, variants: DataFrame, base: str, control: DataFrame, noisy: DataFrame, shuffles: int, limits: dict[str, float], seed: int = 0) -> DataFrame:
    """part, value, limit, passes: the robustness of a strategy.

    results: symbol, id, ret (of the base strategy); variants: variant, score (parameters around base); control:
    shuffled_control() of it; noisy: seed, score (on features with noise). Parts, each at least its limit but for the last
    two, which are at most theirs: same_sign (share of variants with base's sign), held_out (the least mean with one name
    left out), noise (the least score under noise), drawdown (the 95 % quantile of the largest falls of results in shuffled
    orders), control (the mean gain on shuffled returns, over its standard error, in size). A part without values fails."""
    own = V.sensitivity(variants, base).select(F.lit("same_sign").alias("part"), F.col("same_sign").alias("value"))
    held = V.leave_one_out(results).agg(F.lit("held_out").alias("part"), F.min("mean").alias("value"))
    noise = noisy.agg(F.lit("noise").alias("part"), F.min("score").alias("value"))
    falls = shuffled_drawdowns(results.select("id", "ret"), shuffles, seed)
    drawdown = falls.agg(F.lit("drawdown").alias("part"), F.percentile("drawdown", F.lit(0.95)).alias("value"))
    error = F.stddev_samp("gain") / F.sqrt(F.count("gain"))
    chance = control.agg(F.lit("control").alias("part"), F.abs(F.try_divide(F.avg("gain"), F.when(error > 0, error))).alias("value"))
    parts = reduce(DataFrame.unionByName, [own, held, noise, drawdown, chance])
    limit: Column = F.create_map(*(v for k, x in limits.items() for v in (F.lit(k), F.lit(float(x)))))[F.col("part")]
    most = F.col("part").isin("drawdown", "control")
    passes = F.when(most, F.col("value") <= F.col("limit")).otherwise(F.col("value") >= F.col("limit"))
    return parts.withColumn("limit", limit).select("part", "value", "limit", F.coalesce(passes, F.lit(False)).alias("passes"))
