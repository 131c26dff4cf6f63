"""Queries of ensembles of two tree families and a logistic model, fitted in every split; compared with loops in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import numbered
from ..operators import boosting as G
from ..operators import complete as P
from ..operators import cross_section as C
from ..operators import evaluation as E
from ..operators import validation as V
from ..operators.gated_model import round_trip, train_final
from ..sources import views
from ..sources.shared import new_path, written
from .catalog import query
from .features import r6

FEATURES = ("mom", "rev", "vol", "share")
#: Settings of an ensemble as a user would write them.
CONFIG = {
    "level": {"family": "level", "rounds": 4, "depth": 2, "rate": 0.3, "row_share": 0.8},
    "leaf": {"family": "leaf", "rounds": 3, "leaves": 4, "rate": 0.3, "feature_share": 0.75},
    "line": {"family": "logistic", "rounds": 8, "features": ("mom", "rev", "vol")},
}


def labelled_panel(spark, d):
    """Of every nation and month: features at its last day, whether the next month's close is higher, and by how much; id is
    the position in time."""
    day = views.panel(spark, d).withColumn("ret", C.daily_return())
    month = day.groupBy(F.trunc("date", "MM").alias("date"), "symbol").agg(
        F.max_by("close", "date").alias("close"), F.stddev_samp("ret").alias("vol"), F.sum("volume").alias("volume"), F.avg("ret").alias("rev")
    )
    w = C.dated()
    rows = month.withColumns({
        "mom": F.try_divide("close", F.lag("close", 3).over(w)) - 1, "share": F.try_divide("volume", F.sum("volume").over(C.on_date())),
        "fwd": F.try_divide(F.lead("close").over(w), "close") - 1, "next": F.lead("date").over(w),
    })
    rows = rows.where("fwd is not null").select("date", "symbol", *FEATURES, "fwd", (F.col("fwd") > 0).cast("int").alias("y"), F.col("date").alias("start"), F.col("next").alias("stop"))
    return written(numbered(rows, ["date", "symbol"], "id"), "labelled")


@query("m01_boosted_families")
def boosted_families(spark, d):
    """Probabilities of both tree families, fitted on the first 70 % of the months, for the others; the leaf-wise one stops
    early by a tenth of its training months."""
    rows = labelled_panel(spark, d)
    n = rows.count()
    at = F.col("id") / n
    role = F.when(at >= 0.7, "test").when(at >= 0.63, "check").otherwise("train")
    members = {"level": G.Boosted(FEATURES, rounds=6, rate=0.2), "leaf": G.Boosted(FEATURES, "leaf", rounds=10, leaves=5, rate=0.2, patience=2)}
    out = G.members_by_split(rows, rows.select(F.lit(0).alias("split"), "id", role.alias("role")), members)
    return out.select("id", "y", *r6(level=F.col("level"), leaf=F.col("leaf")))


@query("m05_families")
def families(spark, d):
    rows = labelled_panel(spark, d)
    out = E.out_of_fold_ensemble(rows, E.folds_of(rows, 4, 0.01), E.members_from(CONFIG, FEATURES))
    return out.select("split", "id", *r6(**{c: F.col(c) for c in (*CONFIG, "blend", "p")}))


@query("m06_member_quality")
def member_quality(spark, d):
    rows = labelled_panel(spark, d)
    out = E.out_of_fold_ensemble(rows, E.folds_of(rows, 4, 0.01), E.members_from(CONFIG, FEATURES), method="stack")
    return E.member_quality(out, [*CONFIG, "blend", "p"]).select("member", "n", *r6(log_loss=F.col("log_loss"), brier=F.col("brier"), accuracy=F.col("accuracy")))


@query("m11_tuned_families")
def tuned_families(spark, d):
    rows = labelled_panel(spark, d)
    points = {f"depth{k}_rate{r}": G.Boosted(FEATURES, rounds=3, depth=k, rate=r / 10) for k in (1, 2) for r in (1, 5)} | {"line": G.Logistic(("mom", "vol"), rounds=5)}
    return E.tuned_members(rows, E.folds_of(rows, 3, 0.01), points).select("point", *r6(log_loss=F.col("log_loss")), "best")


@query("m12_ensemble_paths")
def ensemble_paths(spark, d):
    """Gated net returns of the ensemble on every path of combinatorial purged cross-validation."""
    rows = labelled_panel(spark, d)
    out = E.ensemble_paths(rows, E.members_from(CONFIG, FEATURES), 4, 2, 0.01, 0.001, regimes=(["vol", "mom"], 2))
    return out.groupBy("path").agg(F.count("*").alias("n"), *r6(mean=F.avg("ret"), sharpe=V.sharpe("ret"), held=F.avg(F.abs("position"))))


@query("m14_gated_positions")
def gated_positions(spark, d):
    """Positions of every nation and month by a model that is trained, saved below the shared folder and loaded again; worst
    is the largest difference between the two models' positions."""
    rows = labelled_panel(spark, d)
    members = {k: v for k, v in E.members_from(CONFIG, FEATURES).items() if k != "leaf"}
    model = train_final(rows, E.folds_of(rows, 3, 0.01), members, regimes=(["vol", "mom"], 2), cost=0.001)
    loaded, worst = round_trip(model, new_path(spark, "model"), rows)
    return loaded.transform(rows).select("id", *r6(p=F.col("p"), position=F.col("position")), "gate", F.lit(worst).alias("worst"))


@query("o15_feature_matrix")
def feature_matrix(spark, d):
    """All columns of the matrix of every bar."""
    out = P.feature_matrix(views.bars(spark, d))
    return out.select("symbol", "ts", *r6(**{c: F.col(c) for c in (*P.FEATURES, "vol_regime", "trend")}))


@query("o15_arms")
def arms(spark, d):
    """The direct and the meta strategy from bars to the distribution of their paths."""
    b = views.bars(spark, d)
    rows = P.pooled(P.labelled_rows(b, P.feature_matrix(b), 0.5, 0.5, 0.05, 10), 20)
    members = {"level": G.Boosted(P.FEATURES, rounds=3, depth=2, rate=0.3), "line": G.Logistic(P.FEATURES, rounds=5, rate=0.2)}
    out = P.arms(rows, members, 4, 2, 0.01, 0.001)
    return out.select("arm", "paths", *r6(**{c: F.col(c) for c in ("median", "mean", "std", "worst", "negative")}))
