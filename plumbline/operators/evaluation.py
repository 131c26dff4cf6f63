"""Ensembles fitted anew in every split of purged cross-validation, all splits in the same passes, and what they earn."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import release, written
from . import boosting as G
from . import models as M
from .ensemble import quality
from .validation import combinatorial_splits, dealt_groups, purged_combinations, purged_folds

Members = dict[str, G.Boosted | G.Logistic]


def members_from(config: dict, features: tuple[str, ...]) -> Members:
    """Members by name from plain settings: name -> family (level, leaf or logistic) and the family's parameters."""
    out: Members = {}
    for name, own in config.items():
        given = {k: v for k, v in own.items() if k != "family"}
        given["features"] = tuple(given.get("features", features))
        family = own["family"]
        if family not in ("level", "leaf", "logistic"):
            raise ValueError(f"{name}: no family {family!r}")
        out[name] = G.Logistic(**given) if family == "logistic" else G.Boosted(growth=family, **given)
    if not out:
        raise ValueError("an ensemble needs a member")
    return out


def blended(scores: DataFrame, members: list[str], reference: Callable[[DataFrame], DataFrame], by: tuple[str, ...], method: str = "rank", **fit) -> DataFrame:
    """Adds blend to scores (by, role, y and the members' columns): by "rank" the mean over members of the share of the
    reference's scores that are at most the row's, by "stack" a logistic model over the members, fitted on the reference.
    Groups of by are told apart; reference picks the rows of scores that a group's blend is fitted on."""
    if method == "rank":
        out = scores
        for m in members:
            out = M.rank_against(out, reference(scores), m, by, f"_{m}")
        mean = sum((F.col(f"_{m}") for m in members), F.lit(0.0)) / len(members)
        return out.withColumn("blend", mean).drop(*(f"_{m}" for m in members))
    if method != "stack":
        raise ValueError(f"no blend {method!r}")
    if len(by) > 1:
        raise ValueError("stacks are fitted by one column at most")
    ready = scores if by else scores.withColumn("_g", F.lit(0))
    key = by[0] if by else "_g"
    beta = M.fit_logistic_by(reference(ready), members, key, **fit)
    return ready.withColumn("blend", M.probability_by(members, key, beta)).drop("_g")


def out_of_fold_ensemble(rows: DataFrame, roles: DataFrame, members: Members, weight: str | None = None, method: str = "rank") -> DataFrame:
    """split, id, y, the members' probabilities, blend and p of every row that a fold of roles (split, id, role) tests.

    Members are fitted fold by fold on the training rows, all in the same passes; blend and calibration are fitted on the
    pooled scores out of fold. A written table."""
    s = G.members_by_split(rows, roles, members, weight)
    both = written(blended(s, list(members), lambda d: d, (), method), "blended")
    out = written(M.calibrate(both, M.isotonic_blocks(both, "blend"), "blend", "p").drop("role"), "ensemble")
    for x in (s, both):
        release(x)
    return out


def member_quality(scores: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """member, by, n, log_loss, brier, accuracy of every column of probabilities of scores (y)."""
    out = None
    for c in columns:
        one = quality(scores.withColumn("p", F.col(c)), by or []).withColumn("member", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out


def tuned_members(rows: DataFrame, roles: DataFrame, points: Members, weight: str | None = None) -> DataFrame:
    """point, log_loss (mean over folds), best: of every point of a grid, given as members. All points and folds are fitted in
    the same passes; ties go to the first point by name."""
    s = G.members_by_split(rows, roles, points, weight)
    folds = member_quality(s, list(points), ["split"]).groupBy(F.col("member").alias("point")).agg(F.avg("log_loss").alias("log_loss"))
    least = folds.agg(F.min(F.struct("log_loss", "point"))["point"].alias("_first"))  # one row
    return folds.join(F.broadcast(least)).select("point", "log_loss", (F.col("point") == F.col("_first")).alias("best"))


def mixtures_by(df: DataFrame, x: list[str], k: int, by: str, rounds: int = 10) -> DataFrame:
    """by and mean, var, weight (arrays of k, means and variances with len(x) in a row) of M.diagonal_mixture() fitted to every
    group of by (a split, say); a round is one aggregate for all groups, a row a group reaches the driver."""
    import numpy as np

    rows = df.select(by, *x).where(" and ".join(f"{c} is not null" for c in x))
    first = rows.groupBy(by).agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x)), F.percentile(x[0], F.array(*(F.lit((j + 0.5) / k) for j in range(k)))).alias("q"))
    fits = {}
    for r in first.collect():
        mean = np.array([[r["q"][j], *(r[f"m{i}"] for i in range(1, len(x)))] for j in range(k)])
        fits[r[by]] = (mean, np.array([[max(r[f"v{i}"], 1e-6) for i in range(len(x))]] * k), np.full(k, 1 / k))
    kind = rows.schema[by].dataType.simpleString()

    def table() -> DataFrame:
        made = []
        for g, (m, v, w) in fits.items():
            order = np.argsort(m[:, 0], kind="stable")
            made.append((g, m[order].ravel().tolist(), v[order].ravel().tolist(), w[order].tolist()))
        return df.sparkSession.createDataFrame(made, f"{by} {kind}, mean array<double>, var array<double>, weight array<double>")

    for _ in range(rounds):
        met = rows.join(F.broadcast(table()), by)
        r = posteriors(x, k)
        sums = met.groupBy(by).agg(
            *(F.sum(r[j]).alias(f"r{j}") for j in range(k)),
            *(F.sum(r[j] * F.col(c)).alias(f"s{j}_{i}") for j in range(k) for i, c in enumerate(x)),
            *(F.sum(r[j] * F.col(c) * F.col(c)).alias(f"q{j}_{i}") for j in range(k) for i, c in enumerate(x)),
        ).collect()  # fmt: skip  a row a group
        for row in sums:
            total = np.array([max(row[f"r{j}"], 1e-9) for j in range(k)])
            mean = np.array([[row[f"s{j}_{i}"] for i in range(len(x))] for j in range(k)]) / total[:, None]
            var = np.maximum(np.array([[row[f"q{j}_{i}"] for i in range(len(x))] for j in range(k)]) / total[:, None] - mean**2, 1e-6)
            fits[row[by]] = (mean, var, total / total.sum())
    return table()


def posteriors(x: list[str], k: int) -> list[Column]:
    """Posterior of each of k components from columns mean, var and weight as mixtures_by() gives them."""
    import math

    logs = []
    for j in range(k):
        out = F.ln(F.get("weight", F.lit(j)) + 1e-300)
        for i, c in enumerate(x):
            m, v = F.get("mean", F.lit(j * len(x) + i)), F.get("var", F.lit(j * len(x) + i))
            out = out - 0.5 * F.ln(2 * math.pi * v) - (F.col(c) - m) * (F.col(c) - m) / v / 2
        logs.append(out)
    top = F.greatest(*logs) if k > 1 else logs[0]
    parts = [F.exp(v - top) for v in logs]
    total = sum(parts, F.lit(0.0))
    return [p / total for p in parts]


def gates_by(rows: DataFrame, x: list[str], gain: str, k: int, by: str, rounds: int = 10) -> DataFrame:
    """Adds gate to rows (by, role, x, gain): regimes of every group are a mixture fitted on its training rows, and a regime's
    gate is 1 where the mean gain of its training rows is positive, else 0; rows with a missing x have gate 1."""
    fits = mixtures_by(rows.where("role = 'train'"), x, k, by, rounds)
    r = posteriors(x, k)
    top = F.greatest(*r) if k > 1 else r[0]
    regime = F.coalesce(*(F.when(p == top, j) for j, p in enumerate(r)))
    placed = rows.join(F.broadcast(fits), by, "left").withColumn("regime", regime).drop("mean", "var", "weight")
    earned = placed.where("role = 'train'").groupBy(by, "regime").agg((F.avg(gain) > 0).cast("double").alias("gate"))
    gated = placed.join(F.broadcast(earned), [by, "regime"], "left")  # k rows a group
    return gated.withColumn("gate", F.when(F.col("regime").isNull(), 1.0).otherwise(F.coalesce("gate", F.lit(0.0))))


def ensemble_paths(
    rows: DataFrame, members: Members, groups: int, test: int, embargo: float, cost: float = 0.0, weight: str | None = None, method: str = "rank", regimes: tuple[list[str], int] | None = None, position: Callable[[Column], Column] = lambda p: 2 * p - 1
) -> DataFrame:
    """path, split, id, position, ret: net returns of the ensemble on the paths of combinatorial purged cross-validation.

    rows: id (positions 0, 1, ... in time), start, stop, y, fwd (return of a unit long position), the members' features, and
    those of regimes (columns, number), if positions are gated. In every split members, blend, calibration, regimes and
    gates are fitted on its training rows alone; the test rows' positions (of p, times the gate) earn fwd less cost times
    their size. All splits are fitted in the same passes. A written table."""
    roles = written(purged_combinations(rows.select(F.col("id").alias("pos"), "start", "stop"), groups, test, embargo).withColumnRenamed("pos", "id"), "roles")
    s = G.members_by_split(rows, roles, members, weight, also=("train",))
    train = lambda d: d.where("role = 'train'")
    both = written(blended(s, list(members), train, ("split",), method), "blended")
    p = M.calibrate(both, M.isotonic_blocks(train(both), "blend", by=("split",)), "blend", "p", ("split",))
    own = p.select("split", "id", "role", "p").join(rows.select("id", "fwd", *(regimes[0] if regimes else [])), "id")
    taken = position(F.col("p"))
    own = own.withColumns({"position": taken, "gain": taken * F.col("fwd") - F.abs(taken) * cost})
    if regimes:
        own = gates_by(written(own, "positions"), *regimes[:1], "gain", regimes[1], "split").withColumn("position", F.col("position") * F.col("gate"))
    at = dealt_groups(rows.select("id"), groups, ["id"])
    tested = own.where("role = 'test'").select("split", "id", "position", (F.col("position") * F.col("fwd") - F.abs("position") * cost).alias("ret"))
    paths = combinatorial_splits(rows.sparkSession, groups, test)
    out = written(tested.join(at, "id").join(F.broadcast(paths), ["split", "grp"]).select("path", "split", "id", "position", "ret"), "paths")
    for x in (roles, s, both):
        release(x)
    return out


def folds_of(rows: DataFrame, k: int, embargo: float) -> DataFrame:
    """split, id, role of purged k-fold cross-validation of rows (id: positions 0, 1, ..., start, stop)."""
    return purged_folds(rows.select(F.col("id").alias("pos"), "start", "stop"), k, embargo).select(F.col("fold").alias("split"), F.col("pos").alias("id"), "role")
