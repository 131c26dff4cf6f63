"""Queries of statistics, cross-validation and overfitting."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.normal import normal_cdf_sql, normal_inverse_sql
from ..operators import bars as B
from ..operators import cross_section as C
from ..operators import validation as V
from ..sources import views
from .catalog import BARS, PANEL, SCORES, query
from .features import RET, r6

R = f"{BARS}, r AS (SELECT *, {RET} AS ret FROM bars)"


def _returns(spark, d):
    return views.bars(spark, d).withColumn("ret", B.log_return())


@query("a12_sharpe", f"WITH {R} SELECT symbol, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe FROM r GROUP BY symbol")
def sharpe(spark, d):
    return _returns(spark, d).groupBy("symbol").agg(*r6(sharpe=V.sharpe("ret", 252)))


@query(
    "a13_moments",
    f"""WITH {R}, m AS (SELECT symbol, avg(ret) AS m, count(ret) AS n, stddev_samp(ret) AS s FROM r GROUP BY symbol)
    SELECT symbol, any_value(n) AS n, round(any_value(m / s), 6) AS sharpe, round(avg(pow(ret - m, 3)) / pow(avg(pow(ret - m, 2)), 1.5), 6) AS skew, round(avg(pow(ret - m, 4)) / pow(avg(pow(ret - m, 2)), 2), 6) AS kurtosis
    FROM r JOIN m USING (symbol) WHERE ret IS NOT NULL GROUP BY symbol""",
)
def moments(spark, d):
    m = V.moments(_returns(spark, d), "ret", ("symbol",))
    return m.select("symbol", "n", *r6(sharpe=F.col("sharpe"), skew=F.col("skew"), kurtosis=F.col("kurtosis")))


BEST = f"sqrt(v) * ({1 - V.EULER}::DOUBLE * ({normal_inverse_sql('1 - 1 / k::DOUBLE')}) + {V.EULER}::DOUBLE * ({normal_inverse_sql(f'1 - 1 / (k * {math.e}::DOUBLE)')}))"
SPREAD = "sqrt(greatest(1e-18::DOUBLE, 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr))"


@query(
    "a14_deflated_sharpe",
    f"""WITH {R}, m AS (SELECT symbol, avg(ret) AS m, count(ret) AS n, avg(ret) / stddev_samp(ret) AS sr FROM r GROUP BY symbol),
    x AS (SELECT symbol, any_value(n) AS n, any_value(sr) AS sr, avg(pow(ret - m, 3)) / pow(avg(pow(ret - m, 2)), 1.5) AS skew, avg(pow(ret - m, 4)) / pow(avg(pow(ret - m, 2)), 2) AS kurtosis FROM r JOIN m USING (symbol) WHERE ret IS NOT NULL GROUP BY symbol),
    t AS (SELECT count(*) AS k, var_samp(sr) AS v FROM x), z AS (SELECT symbol, sr * sqrt(n - 1) / {SPREAD} AS p, (sr - {BEST}) * sqrt(n - 1) / {SPREAD} AS d FROM x, t)
    SELECT symbol, round({normal_cdf_sql("p")}, 6) AS psr, round({normal_cdf_sql("d")}, 6) AS dsr FROM z""",
)
def deflated_sharpe(spark, d):
    """One row a symbol: the trials are the symbols themselves."""
    m = V.moments(_returns(spark, d), "ret", ("symbol",))
    x = m.join(F.broadcast(V.trial_stats(m)))  # one row
    own = [F.col(c) for c in ("sharpe", "n", "skew", "kurtosis")]
    psr = V.probabilistic_sharpe_of(own[0], F.lit(0.0), *own[1:])
    return x.select("symbol", *r6(psr=psr, dsr=V.deflated_sharpe_of(*own, F.col("variance"), F.col("trials"))))


@query(
    "a17_active_ratio",
    f"""WITH {PANEL}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM panel), m AS (SELECT *, ret - avg(ret) OVER (PARTITION BY date) AS active FROM r)
    SELECT symbol, round(avg(active) / stddev_samp(active), 6) AS ir FROM m GROUP BY symbol""",
)
def active_ratio(spark, d):
    r = views.panel(spark, d).withColumn("ret", C.daily_return()).withColumn("active", F.col("ret") - F.avg("ret").over(C.on_date()))
    return r.groupBy("symbol").agg(*r6(ir=V.sharpe("active")))


@query(
    "a19_profit_factor",
    f"WITH {R} SELECT symbol, round(sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret < 0), 6) AS factor, round(max(ret) FILTER (ret > 0) / sum(ret) FILTER (ret > 0), 6) AS concentration FROM r GROUP BY symbol",
)
def profit_factor(spark, d):
    return _returns(spark, d).groupBy("symbol").agg(*r6(factor=V.profit_factor("ret"), concentration=V.concentration("ret")))


@query("a21_regime_breakdown", f"WITH {R} SELECT CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS regime, count(ret) AS n, round(avg(ret), 6) AS mean, CAST(avg(ret) > 0 AS INT) AS multiplier FROM r GROUP BY 1")
def regime_breakdown(spark, d):
    r = _returns(spark, d).withColumn("regime", F.when(F.hour("ts") < 12, "am").otherwise("pm"))
    return r.groupBy("regime").agg(F.count("ret").alias("n"), F.round(F.avg("ret"), 6).alias("mean"), F.when(F.avg("ret") > 0, 1).otherwise(0).alias("multiplier"))


@query(
    "a22_scores",
    f"""WITH {SCORES} SELECT round(avg(CASE WHEN (p >= 0.5)::INT = y THEN 1.0 ELSE 0 END), 6) AS accuracy, round(-avg(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15))), 6) AS log_loss,
    round(avg(pow(p - y, 2)), 6) AS brier FROM scores""",
)
def score_stats(spark, d):
    return views.scores(spark, d).agg(*r6(accuracy=V.accuracy(), log_loss=V.log_loss(), brier=V.brier()))


@query(
    "a23_roc_auc",
    f"""WITH {SCORES}, k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM scores)
    SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM k""",
)
def roc_auc(spark, d):
    return V.roc_auc(views.scores(spark, d)).select(*r6(auc=F.col("auc")))


@query(
    "a28_curve_stats",
    f"""WITH {PANEL}, x AS (SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS f FROM panel)
    SELECT symbol, round(pow(arg_max(close, date) / arg_min(close, date), 365.25 / (max(date) - min(date))) - 1, 6) AS cagr, round(min(f), 6) AS drawdown FROM x GROUP BY symbol""",
)
def curve_stats(spark, d):
    s = V.curve_stats(views.panel(spark, d).withColumnRenamed("close", "equity"))
    return s.select("symbol", *r6(cagr=F.col("cagr"), drawdown=F.col("drawdown")))


@query(
    "a29_additive_drawdown",
    f"""WITH {R}, c AS (SELECT *, sum(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM r WHERE ret IS NOT NULL),
    m AS (SELECT *, max(c) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - c AS f FROM c) SELECT symbol, round(max(f), 6) AS drawdown FROM m GROUP BY symbol""",
)
def additive_drawdown(spark, d):
    return V.additive_drawdown(_returns(spark, d).where("ret is not null"), "ret").select("symbol", *r6(drawdown=F.col("drawdown")))


def _labels(spark, d):
    from pyspark.sql import Window

    e = views.table(spark, d, "events").where("user_id is not null")
    return e.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("pos"), F.col("ts").alias("start"), F.expr("ts + interval 6 hours").alias("stop"))


@query(
    "r20_purged_folds",
    """WITH l AS (SELECT user_id, row_number() OVER u - 1 AS pos, ts AS start, ts + INTERVAL 6 HOUR AS stop, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE user_id IS NOT NULL WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, ntile(5) OVER (PARTITION BY user_id ORDER BY pos) - 1 AS fold FROM l), t AS (SELECT user_id, fold, min(start) AS a, max(stop) AS b, max(pos) AS last FROM b GROUP BY ALL),
    x AS (SELECT t.user_id, t.fold, b.pos, CASE WHEN b.fold = t.fold THEN 'test' WHEN b.stop < t.a OR (b.start > t.b AND pos > last + floor(n * 0.02)) THEN 'train' END AS role FROM b JOIN t ON b.user_id = t.user_id)
    SELECT user_id, CAST(fold AS INT) AS fold, CAST(pos AS INT) AS pos, role FROM x WHERE role IS NOT NULL""",
)
def purged_folds(spark, d):
    """Folds of every user's labels."""
    return V.purged_folds(_labels(spark, d), 5, 0.02, ("user_id",))


@query(
    "r21_combinatorial_paths",
    f"""WITH {R}, g AS (SELECT ret, ntile(4) OVER (ORDER BY ts, symbol) - 1 AS grp FROM r WHERE ret IS NOT NULL),
    c(split, grp, path) AS (VALUES (0, 0, 0), (0, 1, 0), (1, 0, 1), (1, 2, 0), (2, 0, 2), (2, 3, 0), (3, 1, 1), (3, 2, 1), (4, 1, 2), (4, 3, 1), (5, 2, 2), (5, 3, 2)),
    x AS (SELECT path, ret * (1 + split / 10.0) AS ret FROM g JOIN c USING (grp)), p AS (SELECT path, avg(ret) / stddev_samp(ret) AS s FROM x GROUP BY path)
    SELECT round(quantile_cont(s, 0.5), 6) AS median, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, round(min(s), 6) AS worst, round(avg((s < 0)::INT), 6) AS negative, count(*) AS paths FROM p""",
)
def combinatorial_paths(spark, d):
    r = _returns(spark, d).where("ret is not null")
    g = V.dealt_groups(r.select("ts", "symbol", "ret"), 4, ["ts", "symbol"])
    met = g.join(V.combinatorial_splits(spark, 4, 2), "grp").select("path", (F.col("ret") * (1 + F.col("split") / 10.0)).alias("ret"))
    s = V.path_distribution(met)
    return s.select(*r6(**{c: F.col(c) for c in ("median", "mean", "std", "worst", "negative")}), "paths")


@query("a30_overfitting_probability")
def overfitting_probability(spark, d):
    r = _returns(spark, d).where("ret is not null").select(F.col("symbol").alias("strategy"), F.pmod(F.datediff("ts", F.lit("2024-01-01")), F.lit(8)).alias("part"), "ret")
    logits = V.overfitting_probability(r, 8)
    return logits.agg(F.count("*").alias("combos"), F.round(F.avg((F.col("logit") <= 0).cast("int")), 6).alias("pbo"))
