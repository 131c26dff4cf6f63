"""Models trained out of fold, combined, calibrated, gated by regimes, and tuned by purged cross-validation."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import models as M
from .cross_section import rank_share
from .validation import accuracy, brier, log_loss, roc_auc


def out_of_fold(rows: DataFrame, roles: DataFrame, features: list[str], **fit) -> DataFrame:
    """id, fold, y, p: each row's probability by the logistic model of every fold that tests it, trained on that fold's
    training rows. rows: id, y and features; roles: fold, id, role (train or test). All folds are fitted at once."""
    met = roles.join(rows, "id")
    beta = M.fit_logistic_by(met.where("role = 'train'"), features, "fold", **fit)
    return met.where("role = 'test'").select("id", "fold", "y", M.probability_by(features, "fold", beta).alias("p"))


def members_out_of_fold(rows: DataFrame, roles: DataFrame, members: dict[str, list[str]], **fit) -> DataFrame:
    """id, fold, y and a column of probabilities for every member, a list of features by name."""
    out = None
    for name, features in members.items():
        own = out_of_fold(rows, roles, features, **fit).withColumnRenamed("p", name)
        out = own if out is None else out.join(own.drop("y"), ["id", "fold"])
    return out


def combined(scores: DataFrame, members: list[str], by: str = "fold") -> DataFrame:
    """Adds p: the mean over members of a score's average-tie rank share among its fold's."""
    from pyspark.sql import Window

    w = Window.partitionBy(by)
    return scores.withColumn("p", sum((rank_share(m, w) for m in members), F.lit(0.0)) / len(members))


def stacked(scores: DataFrame, members: list[str], **fit) -> DataFrame:
    """Adds p: a logistic model over the members' scores, fitted on those out-of-fold scores."""
    ready = M.standardised(scores, members)
    return ready.withColumn("p", M.probability(members, M.fit_logistic(ready, members, **fit)))


def quality(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, n, log_loss, brier, accuracy of scores (y, p)."""
    return scores.groupBy(*by).agg(F.count("*").alias("n"), log_loss().alias("log_loss"), brier().alias("brier"), accuracy().alias("accuracy"))


def regime_gate(posteriors: list[Column], multipliers: list[float], least: float = 0.0) -> Column:
    """The multiplier of the most likely regime, ties to the first; 1 where its posterior is below least or missing."""
    top = F.greatest(*posteriors)
    out = None
    for p, m in zip(posteriors, multipliers, strict=True):
        out = F.when(p == top, m) if out is None else out.when(p == top, m)
    return F.when(top >= least, out).otherwise(1.0)


def fitted_gate(rows: DataFrame, x: list[str], gain: str, k: int, rounds: int = 10) -> tuple[dict, list[float]]:
    """A mixture of k regimes over x and a multiplier for each: 1 where the mean gain of its rows is positive, else 0."""
    fit = M.diagonal_mixture(rows, x, k, rounds)
    r = M.responsibilities(x, **fit)
    top = F.greatest(*r) if k > 1 else r[0]
    sums = rows.agg(*(F.avg(F.when(p == top, F.col(gain))).alias(f"g{j}") for j, p in enumerate(r))).first()
    return fit, [1.0 if (sums[f"g{j}"] or 0.0) > 0 else 0.0 for j in range(k)]


def gated_position(p: Column, gate: Column) -> Column:
    """Position of a probability, scaled by its gate."""
    return (2 * p - 1) * gate


def bet_size(p: Column) -> Column:
    """Size of a bet on a side that is right with probability p: nothing up to one half."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (p - 0.5)))


def tuned(rows: DataFrame, roles: DataFrame, features: list[str], grid: dict[str, list]) -> DataFrame:
    """A row for every point of the grid (parameters of fit_logistic): its parameters, mean log loss of the folds, best.
    Each point is one out-of-fold fit of all folds."""
    out = None
    for point in product(*grid.values()):
        fit = dict(zip(grid, point, strict=True))
        folds = quality(out_of_fold(rows, roles, features, **fit), ["fold"])
        one = folds.agg(F.avg("log_loss").alias("log_loss")).select(*(F.lit(v).alias(k) for k, v in fit.items()), "log_loss")
        out = one if out is None else out.unionByName(one)
    least = out.agg(F.min("log_loss").alias("_least"))  # one row
    return out.join(F.broadcast(least)).withColumn("best", F.col("log_loss") == F.col("_least")).drop("_least")


def auc_by(scores: DataFrame, by: str, groups: list) -> DataFrame:
    """by, auc for each of the groups."""
    out = None
    for g in groups:
        one = roc_auc(scores.where(F.col(by) == g)).withColumn(by, F.lit(g))
        out = one if out is None else out.unionByName(one)
    return out
