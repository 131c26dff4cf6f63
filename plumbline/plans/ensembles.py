"""Queries of models trained out of fold, gates and tuning; the plain loops they are compared with are in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import numbered
from ..operators import cross_section as C
from ..operators import ensemble as E
from ..operators import models as M
from ..operators import validation as V
from ..sources import views
from ..sources.runs import RunLog
from ..sources.shared import new_path
from .catalog import PANEL, SCORES, query
from .cross import RET
from .features import r6
from .research import SPLITS, _active


def _rows(spark, d):
    """id (a position), y and three made-up features of the scored documents."""
    s = numbered(views.scores(spark, d), ["id"], "pos")
    rows = s.select(F.col("pos").alias("id"), "y", "p", (F.col("id") % 7).cast("double").alias("q"), (F.col("p") * F.col("p")).alias("pp"))
    return M.standardised(rows, ["p", "q", "pp"])


def _roles(rows, k=5):
    labels = rows.select(F.col("id").alias("pos"), F.col("id").alias("start"), (F.col("id") + 3).alias("stop"))
    return V.purged_folds(labels, k, 0.01).withColumnRenamed("pos", "id")


@query("m06_out_of_fold")
def out_of_fold(spark, d):
    rows = _rows(spark, d)
    return E.out_of_fold(rows, _roles(rows), ["p", "q"], rounds=10).select("id", "fold", *r6(p=F.col("p")))


@query("m05_ensemble")
def ensemble(spark, d):
    rows = _rows(spark, d)
    scores = E.members_out_of_fold(rows, _roles(rows), {"one": ["p"], "two": ["q"], "all": ["p", "q", "pp"]}, rounds=10)
    return E.combined(scores, ["one", "two", "all"]).select("id", "fold", *r6(p=F.col("p")))


@query("m04_stacked")
def stacked(spark, d):
    rows = _rows(spark, d)
    scores = E.members_out_of_fold(rows, _roles(rows), {"one": ["p"], "two": ["q"]}, rounds=10)
    return E.stacked(scores, ["one", "two"], rounds=10).select("id", "fold", *r6(p=F.col("p")))


@query("m06_summary")
def summary(spark, d):
    rows = _rows(spark, d)
    return E.quality(E.out_of_fold(rows, _roles(rows), ["p", "q"], rounds=10), ["fold"])


@query("m11_tuned")
def tuned(spark, d):
    rows = _rows(spark, d)
    return E.tuned(rows, _roles(rows, 3), ["p", "q"], {"l2": [0.1, 10.0], "rounds": [3, 6]})


@query(
    "m09_regime_gate",
    f"""WITH {SCORES}, r AS (SELECT id, p, (p * p) / (p * p + 0.09 + (1 - p) * (1 - p)) AS a, 0.09 / (p * p + 0.09 + (1 - p) * (1 - p)) AS b, (1 - p) * (1 - p) / (p * p + 0.09 + (1 - p) * (1 - p)) AS c FROM scores)
    SELECT id, round((2 * p - 1) * CASE WHEN greatest(a, b, c) < 0.5 THEN 1 WHEN a = greatest(a, b, c) THEN 1.5 WHEN b = greatest(a, b, c) THEN 0 ELSE 0.5 END, 6) AS position FROM r""",
)
def regime_gate(spark, d):
    """Positions under a gate by three made-up posteriors."""
    s = views.scores(spark, d)
    p = F.col("p")
    parts = [p * p, F.lit(0.09), (1 - p) * (1 - p)]
    total = p * p + 0.09 + (1 - p) * (1 - p)
    gate = E.regime_gate([x / total for x in parts], [1.5, 0.0, 0.5], 0.5)
    return s.select("id", *r6(position=E.gated_position(p, gate)))


@query(
    "m12_gated_paths",
    f"""WITH {SCORES}, n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos, CASE WHEN p >= 0.3 AND p <= 0.7 THEN 0 ELSE 1 END AS g FROM scores), x AS (SELECT pos, (2 * p - 1) * g * (y - 0.5) - abs((2 * p - 1) * g) * 0.01 AS net FROM n),
    grp AS (SELECT net, ntile(4) OVER (ORDER BY pos) - 1 AS grp FROM x), {SPLITS}, pa AS (SELECT path, avg(net) / stddev_samp(net) AS s FROM grp JOIN c USING (grp) GROUP BY path)
    SELECT round(quantile_cont(s, 0.5), 6) AS median, round(min(s), 6) AS worst, count(*) AS paths FROM pa""",
)
def gated_paths(spark, d):
    """Net returns of gated positions under combinatorial cross-validation."""
    s = views.scores(spark, d).withColumn("pos", E.gated_position(F.col("p"), F.when(F.col("p").between(0.3, 0.7), 0.0).otherwise(1.0)))
    net = s.select("id", (F.col("pos") * (F.col("y") - 0.5) - F.abs("pos") * 0.01).alias("ret"))
    out = V.path_distribution(V.combinatorial_results(net, 4, 2, ["id"]))
    return out.select(*r6(median=F.col("median"), worst=F.col("worst")), "paths")


@query("o15_bet_sizes", f"WITH {SCORES} SELECT id, round(greatest(0, least(1, 2 * (p - 0.5))), 6) AS size FROM scores")
def bet_sizes(spark, d):
    return views.scores(spark, d).select("id", *r6(size=E.bet_size(F.col("p"))))


@query("m13_date_folds")
def date_folds(spark, d):
    """Probabilities that a name beats its date's median over the next 5 rows, out of folds of purged dates."""
    p = views.panel(spark, d).withColumns({"mom": C.momentum(20, 0), "fwd": F.try_divide(F.lead("close", 5).over(C.dated()), "close") - 1, "last": F.lead("date", 5).over(C.dated())})
    p = p.where("mom is not null and fwd is not null").withColumn("y", (F.col("fwd") >= F.percentile("fwd", F.lit(0.5)).over(C.on_date())).cast("int"))
    days = numbered(p.groupBy("date").agg(F.max("last").alias("stop")), ["date"], "pos")
    roles = V.purged_folds(days.select("pos", F.col("date").alias("start"), "stop"), 4, 0.01)
    placed = days.select("date", "pos").join(roles, "pos").select("date", "fold", "role")
    rows = M.standardised(p.select("date", "symbol", "y", "mom"), ["mom"]).withColumn("id", F.concat_ws("|", "date", "symbol"))
    out = E.out_of_fold(rows.select("id", "y", "mom"), rows.select("id", "date").join(placed, "date").drop("date"), ["mom"], rounds=5)
    return out.select("id", "fold", *r6(p=F.col("p")))


@query(
    "o11_share_targets",
    f"WITH {PANEL}, {RET} SELECT date, symbol, CAST(round_even(sign(ret) * 10000 / close, 0) AS BIGINT) AS target FROM r WHERE ret IS NOT NULL",
)
def share_targets(spark, d):
    r = views.panel(spark, d).withColumn("ret", C.daily_return()).where("ret is not null")
    return r.select("date", "symbol", F.bround(F.try_divide(F.signum("ret") * 10_000, F.col("close"))).cast("long").alias("target"))


@query("r34_grid_verdict", f"WITH {PANEL}, {RET}, g AS (SELECT symbol, avg(ret) / stddev_samp(ret) AS s, count(ret) AS n FROM r GROUP BY symbol) SELECT arg_max(symbol, s) AS best, round(max(s), 6) AS ratio, count(*) AS trials, max(s) > 0.2 AS passes FROM g")
def grid_verdict(spark, d):
    """The best of the configurations (here the names), and whether it is above what is asked."""
    g = views.panel(spark, d).withColumn("ret", C.daily_return()).groupBy("symbol").agg(V.sharpe("ret").alias("s"))
    return g.agg(F.max_by("symbol", "s").alias("best"), F.round(F.max("s"), 6).alias("ratio"), F.count("*").alias("trials"), (F.max("s") > 0.2).alias("passes"))


NAMES = f"WITH {PANEL}, {RET}, g AS (SELECT symbol, avg(ret) / stddev_samp(ret) AS s FROM r GROUP BY symbol)"


def _trials(spark, d):
    """A log of the ratios of all names in order, each a run: made anew below the shared folder."""
    g = views.panel(spark, d).withColumn("ret", C.daily_return()).groupBy("symbol").agg(V.sharpe("ret").alias("s"))
    log = RunLog(spark, new_path(spark, "runs"))
    for r in g.orderBy("symbol").collect():  # a row a configuration
        log.append(r["symbol"], {"symbol": r["symbol"]}, {"sharpe": r["s"]} if r["s"] is not None else {})
    return log


@query("s36_runs", f"{NAMES} SELECT row_number() OVER (ORDER BY symbol) AS run, symbol AS name, round(s, 6) AS sharpe FROM g")
def runs(spark, d):
    return _trials(spark, d).runs().select("run", "name", F.round(F.col("metrics")["sharpe"], 6).alias("sharpe"))


@query("s36_trial_count", f"{NAMES} SELECT count(*) AS trials, round(var_samp(s), 6) AS variance FROM g")
def trial_count(spark, d):
    return _trials(spark, d).trials("sharpe").select("trials", F.round("variance", 6).alias("variance"))


@query("r36_trials_and_deflation")
def trials_and_deflation(spark, d):
    """Deflated ratio of the active book at the number and variance of the trials in the log of runs."""
    m = V.moments(_active(spark, d), "net").join(F.broadcast(_trials(spark, d).trials("sharpe")))  # one row each
    dsr = V.deflated_sharpe_of(*(F.col(c) for c in ("sharpe", "n", "skew", "kurtosis", "variance", "trials")))
    return m.select("trials", "sharpe", dsr.alias("deflated"))
