"""Queries of fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..sources import views
from .catalog import SCORES, query


@query(
    "m02_logistic_step",
    f"""WITH {SCORES}, s AS (SELECT id, y, (p - avg(p) OVER ()) / stddev_pop(p) OVER () AS p FROM scores), g AS (SELECT sum(0.5 - y) / count(*) AS g0, sum((0.5 - y) * p) / count(*) AS g1 FROM s)
    SELECT round(-0.5 * g0, 6) AS intercept, round(-0.5 * g1, 6) AS weight FROM g""",
)
def logistic_step(spark, d):
    s = M.standardised(views.scores(spark, d), ["p"])
    b = M.fit_logistic(s, ["p"], rounds=1)
    return spark.createDataFrame([(round(b[0], 6), round(b[1], 6))], "intercept double, weight double")


@query("m02b_logistic")
def logistic(spark, d):
    s = M.standardised(views.scores(spark, d), ["p"])
    return s.select("id", M.probability(["p"], M.fit_logistic(s, ["p"], rounds=10)).alias("prob"))


@query("m03_isotonic")
def isotonic(spark, d):
    s = views.scores(spark, d)
    return M.calibrate(s, M.isotonic_blocks(s), name="prob").select("id", "prob")


@query(
    "m04_rank_average",
    f"WITH {SCORES} SELECT id, round((SELECT count(*) FROM scores r WHERE r.y = 1 AND r.p <= s.p) / (SELECT count(*) FROM scores WHERE y = 1)::DOUBLE, 6) AS share FROM scores s",
)
def rank_average(spark, d):
    s = views.scores(spark, d)
    return M.rank_against(s, s.where("y = 1")).select("id", F.round("share", 6).alias("share"))


@query("m08_regime_mixture")
def regime_mixture(spark, d):
    e = views.table(spark, d, "events").select("event_id", F.ln("value").alias("x"), (F.col("event_id") % 10).cast("double").alias("z"))
    fit = M.diagonal_mixture(e, ["x", "z"], 2, 5)
    return e.select("event_id", *(r.alias(f"p{j}") for j, r in enumerate(M.responsibilities(["x", "z"], **fit))))


@query("m10_kmeans")
def kmeans(spark, d):
    return M.kmeans(views.table(spark, d, "embeddings"), 5).select("vec_id", F.col("prediction").alias("cluster"))


@query("m01_boosted_trees")
def boosted_trees(spark, d):
    s = views.scores(spark, d).withColumns({"a": F.col("p"), "b": (F.col("id") % 7).cast("double")}).drop("p")
    return M.boosted_trees(s, ["a", "b"], rounds=5).select("id", "p")
