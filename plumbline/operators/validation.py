"""Performance and score statistics, purged cross-validation, combinatorial paths, overfitting probability."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import numbered, summed, upto
from ..functions.normal import normal_cdf, normal_inverse

EULER = 0.5772156649015329


def sharpe(x: str | Column, per_year: float | None = None) -> Column:
    """Mean over sample deviation, times the root of per_year; 0 for a flat zero series, missing for another flat one."""
    mean, std = F.avg(x), F.stddev_samp(x)
    value = F.when((std == 0) & (mean == 0), 0.0).otherwise(F.try_divide(mean, F.when(std != 0, std)))
    return value * math.sqrt(per_year) if per_year else value


def moments(df: DataFrame, x: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, sharpe, skew (biased), kurtosis (biased, normal is 3)."""
    return df.groupBy(*by).agg(F.count(x).alias("n"), sharpe(x).alias("sharpe"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurtosis"))


def probabilistic_sharpe(sr: float, benchmark: float, n: int, skew: float, kurtosis: float) -> float:
    """Probability that the true ratio is above benchmark."""
    spread = math.sqrt(max(1e-18, 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr))
    return NormalDist().cdf((sr - benchmark) * math.sqrt(n - 1) / spread)


def expected_best_sharpe(variance: float, trials: int) -> float:
    if trials <= 1:
        return 0.0
    q = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * q(1 - 1 / trials) + EULER * q(1 - 1 / (trials * math.e)))


def deflated_sharpe(sr: float, n: int, skew: float, kurtosis: float, variance: float, trials: int) -> float:
    return probabilistic_sharpe(sr, expected_best_sharpe(variance, trials), n, skew, kurtosis)


def probabilistic_sharpe_of(sr: Column, benchmark: Column, n: Column, skew: Column, kurtosis: Column) -> Column:
    """probabilistic_sharpe() of columns; missing where one is."""
    spread = F.sqrt(F.greatest(F.lit(1e-18), 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr))
    return normal_cdf((sr - benchmark) * F.sqrt(n - 1) / spread)


def expected_best_sharpe_of(variance: Column, trials: Column) -> Column:
    """expected_best_sharpe() of columns: 0 for a single trial."""
    best = (1 - EULER) * normal_inverse(1 - 1 / trials) + EULER * normal_inverse(1 - 1 / (trials * math.e))
    return F.when(trials <= 1, 0.0).otherwise(F.sqrt(variance) * best)


def deflated_sharpe_of(sr: Column, n: Column, skew: Column, kurtosis: Column, variance: Column, trials: Column) -> Column:
    return probabilistic_sharpe_of(sr, expected_best_sharpe_of(variance, trials), n, skew, kurtosis)


def profit_factor(x: str) -> Column:
    return F.try_divide(F.sum(F.when(F.col(x) > 0, F.col(x)).otherwise(0.0)), -F.sum(F.when(F.col(x) < 0, F.col(x)).otherwise(0.0)))


def concentration(x: str) -> Column:
    """The largest gain's share of all gains."""
    return F.try_divide(F.max(F.when(F.col(x) > 0, F.col(x))), F.sum(F.when(F.col(x) > 0, F.col(x))))


def log_loss(y: str = "y", p: str = "p") -> Column:
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    return -F.avg(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))


def brier(y: str = "y", p: str = "p") -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), 2))


def accuracy(y: str = "y", p: str = "p") -> Column:
    return F.avg(F.when((F.col(p) >= 0.5).cast("int") == F.col(y), 1.0).otherwise(0.0))


def roc_auc(scores: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """auc: the chance that a positive's score is above a negative's, ties half. Scores are counted by value first, so
    that the ordered pass sees one row for each distinct score."""
    per = scores.groupBy(p).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    wins = summed(per, [p], "neg", "_upto").withColumn("wins", F.col("pos") * (F.col("_upto") - F.col("neg") / 2))
    return wins.agg(F.try_divide(F.sum("wins"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def additive_drawdown(df: DataFrame, x: str, by: str = "symbol", order: str = "ts") -> DataFrame:
    """Largest fall of the cumulative sum from its running maximum."""
    w = upto(Window.partitionBy(by).orderBy(order))
    path = df.withColumn("_c", F.sum(x).over(w))
    return path.withColumn("_d", F.max("_c").over(w) - F.col("_c")).groupBy(by).agg(F.max("_d").alias("drawdown"))


def curve_stats(curve: DataFrame, by: str = "symbol", day: str = "date", equity: str = "equity") -> DataFrame:
    """cagr by calendar days, and the largest relative fall."""
    w = upto(Window.partitionBy(by).orderBy(day))
    fall = curve.withColumn("_f", F.col(equity) / F.max(equity).over(w) - 1)
    years = F.datediff(F.max(day), F.min(day)) / 365.25
    growth = F.try_divide(F.max_by(equity, day), F.min_by(equity, day))
    return fall.groupBy(by).agg((F.pow(growth, F.try_divide(F.lit(1.0), years)) - 1).alias("cagr"), F.min("_f").alias("drawdown"))


def purged_folds(labels: DataFrame, k: int, embargo: float, by: tuple[str, ...] = ()) -> DataFrame:
    """by, fold, pos, role (train or test) for labels (by, pos, start, stop): the test blocks are contiguous, of equal
    size up to one; a training label doesn't overlap the block's time and doesn't lie in the embargo after it.

    labels of each group of by are numbered 0, 1, ... by pos and have folds of their own; only the k blocks' bounds of a
    group meet its labels again."""
    n = labels.groupBy(*by).agg(F.count("*").alias("n"))
    placed = labels.join(n, list(by)) if by else labels.crossJoin(n)
    # the first n mod k blocks have one more
    small, extra = F.floor(F.col("n") / k), F.col("n") % k
    cut = (small + 1) * extra
    block = F.when(F.col("pos") < cut, F.floor(F.col("pos") / (small + 1))).otherwise(extra + F.floor((F.col("pos") - cut) / small)).cast("int")
    placed = placed.withColumn("block", block)
    runs = placed.groupBy(*by, F.col("block").alias("fold")).agg(F.min("start").alias("a"), F.max("stop").alias("b"), F.max("pos").alias("last"), F.first("n").alias("_n"))
    met = placed.join(runs, list(by)) if by else placed.join(F.broadcast(runs))  # k rows
    train = (F.col("stop") < F.col("a")) | ((F.col("start") > F.col("b")) & (F.col("pos") > F.col("last") + F.floor(F.col("_n") * embargo)))
    role = F.when(F.col("block") == F.col("fold"), "test").when(train, "train")
    return met.select(*by, "fold", "pos", role.alias("role")).where("role is not null")


def combinatorial_splits(spark: SparkSession, groups: int, test: int) -> DataFrame:
    """split, grp, path: in each split test of the groups are tested; a group's turns are dealt to the paths in order."""
    seen = dict.fromkeys(range(groups), 0)
    rows = []
    for split, chosen in enumerate(combinations(range(groups), test)):
        for g in chosen:
            rows.append((split, g, seen[g]))
            seen[g] += 1
    return spark.createDataFrame(rows, "split int, grp int, path int")


def path_distribution(results: DataFrame) -> DataFrame:
    """Of path results (path, ret): median, mean, deviation, least, share below 0 of the paths' Sharpe ratios."""
    per = results.groupBy("path").agg(sharpe("ret").alias("s"))
    return per.agg(
        F.percentile("s", F.lit(0.5)).alias("median"), F.avg("s").alias("mean"), F.stddev_samp("s").alias("std"),
        F.min("s").alias("worst"), F.avg((F.col("s") < 0).cast("int")).alias("negative"), F.count("*").alias("paths"),
    )


def overfitting_probability(returns: DataFrame, partitions: int) -> DataFrame:
    """combo, logit of every choice of half the partitions as in-sample: the rank out of sample of the strategy that is
    best in sample. returns: strategy, part (0 .. partitions - 1), ret.

    Each strategy's partitions are reduced to count, sum and sum of squares; combinations only add those."""
    spark = returns.sparkSession
    combos = [(i, p, p in set(c)) for i, c in enumerate(combinations(range(partitions), partitions // 2)) for p in range(partitions)]
    sides = spark.createDataFrame(combos, "combo int, part int, inside boolean")
    sums = returns.groupBy("strategy", "part").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    both = sums.join(sides, "part").groupBy("combo", "strategy", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    variance = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    both = both.withColumn("sr", F.coalesce(F.try_divide(F.col("s") / F.col("n"), F.sqrt(F.greatest(variance, F.lit(0.0)))), F.lit(0.0)))
    inside, outside = both.where("inside"), both.where("not inside")
    best = inside.groupBy("combo").agg(F.min(F.struct((-F.col("sr")).alias("m"), "strategy"))["strategy"].alias("strategy"))
    w = Window.partitionBy("combo")
    ranked = outside.withColumn("rank", F.rank().over(w.orderBy("sr")) + (F.count("*").over(w.orderBy("sr").rangeBetween(0, 0)) - 1) / 2).withColumn("m", F.count("*").over(w))
    share = F.col("rank") / (F.col("m") + 1)
    return ranked.join(best, ["combo", "strategy"], "left_semi").select("combo", "strategy", F.ln(share / (1 - share)).alias("logit"))


def leave_one_out(results: DataFrame, unit: str = "symbol", x: str = "ret") -> DataFrame:
    """held_out, n, mean, sharpe of all results but one unit's, for every unit. Units are reduced to count, sum and sum of
    squares once; each is then taken off the total."""
    own = results.groupBy(unit).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    total = own.agg(*(F.sum(c).alias(f"all_{c}") for c in "nsq"))  # one row
    rest = own.join(F.broadcast(total)).select(F.col(unit).alias("held_out"), *((F.col(f"all_{c}") - F.col(c)).alias(c) for c in "nsq"))
    mean = F.try_divide("s", "n")
    spread = F.sqrt(F.greatest(F.try_divide(F.col("q") - F.col("s") * mean, F.col("n") - 1), F.lit(0.0)))
    return rest.select("held_out", "n", mean.alias("mean"), F.try_divide(mean, F.when(spread > 0, spread)).alias("sharpe"))


def dealt_groups(results: DataFrame, groups: int, order: list[str]) -> DataFrame:
    """Adds grp: contiguous groups in order, the first n mod groups with one row more. Rows are counted by range partition,
    so that no task sees all of them."""
    placed = numbered(results, order, "_at")
    n = placed.agg(F.count("*").alias("_n"))  # one row
    small, extra = F.floor(F.col("_n") / groups), F.col("_n") % groups
    cut = (small + 1) * extra
    grp = F.when(F.col("_at") < cut, F.floor(F.col("_at") / (small + 1))).otherwise(extra + F.floor((F.col("_at") - cut) / F.greatest(small, F.lit(1))))
    return placed.join(F.broadcast(n)).withColumn("grp", grp.cast("int")).drop("_at", "_n")


def combinatorial_results(results: DataFrame, groups: int, test: int, order: list[str]) -> DataFrame:
    """split, path and the columns of results, each row once for every split that tests its group."""
    return dealt_groups(results, groups, order).join(F.broadcast(combinatorial_splits(results.sparkSession, groups, test)), "grp")


def purged_combinations(labels: DataFrame, groups: int, test: int, embargo: float) -> DataFrame:
    """split, pos, role of labels (pos, start, stop; pos from 0): combinatorial purged cross-validation. A label is tested
    where its group is; it is trained on where it overlaps no tested group's time nor lies in the embargo after one."""
    folds = purged_folds(labels, groups, embargo).withColumnRenamed("fold", "grp")
    splits = combinatorial_splits(labels.sparkSession, groups, test).select("split", "grp")
    met = folds.join(F.broadcast(splits), "grp").groupBy("split", "pos").agg(
        F.max((F.col("role") == "test").cast("int")).alias("tested"), F.sum((F.col("role") == "train").cast("int")).alias("free")
    )
    role = F.when(F.col("tested") == 1, "test").when(F.col("free") == test, "train")
    return met.select("split", "pos", role.alias("role")).where("role is not null")


def per_year(n: Column, first: Column, last: Column) -> Column:
    """Events per year of the calendar time between two days; missing without any."""
    return F.try_divide(n.cast("double"), F.when(F.datediff(last, first) > 0, F.datediff(last, first) / 365.25))


def trial_stats(trials: DataFrame, x: str = "sharpe") -> DataFrame:
    """One row: trials, variance of their ratios (sample; 0 below two)."""
    return trials.agg(F.count("*").alias("trials"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("variance"))


def sensitivity(variants: DataFrame, base: str, x: str = "score") -> DataFrame:
    """One row of variants (variant, score): base score, least, mean, deviation, share that keeps the base's sign, spread
    over the absolute base."""
    own = variants.where(F.col("variant") == base).agg(F.max(x).alias("base"))
    return variants.join(F.broadcast(own)).agg(
        F.max("base").alias("base"), F.min(x).alias("least"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("deviation"),
        F.avg((F.signum(x) == F.signum("base")).cast("int")).alias("same_sign"),
        F.try_divide(F.max(x) - F.min(x), F.abs(F.max("base"))).alias("spread"),
    )


def gate(stats: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Adds failed, the names of the tests that don't hold (a missing value fails), comma-joined, and passes."""
    failed = F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), None).otherwise(k) for k, v in tests.items())))
    return stats.withColumn("failed", F.array_join(failed, ",")).withColumn("passes", F.col("failed") == "")


def deduplicated(paths: DataFrame, x: str) -> DataFrame:
    """n, paths, t, negative of path results (path, x) end to end: the t statistic over the root of the number of paths, as
    every path holds the same events; 0 for fewer than two or flat results."""
    g = paths.agg(F.count(x).alias("n"), F.count_distinct("path").alias("paths"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"), F.avg((F.col(x) < 0).cast("int")).alias("negative"))
    one = F.col("_m") / F.col("_s") * F.sqrt("n") / F.sqrt(F.greatest("paths", F.lit(1)))
    # end to end, the deviation is that of n rows of which n / paths differ
    return g.select("n", "paths", F.when((F.col("n") > 1) & (F.col("_s") > 0), one).otherwise(0.0).alias("t"), "negative")
