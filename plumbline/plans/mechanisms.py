"""Queries of event strategies, panels of configurations and robustness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import normal_cdf_sql, normal_inverse_sql
from ..operators import bars as B
from ..operators import cross_section as C
from ..operators import events as E
from ..operators import factor_gate as G
from ..operators import mechanisms as X
from ..operators import validation as V
from ..sources import exchange, views
from .catalog import PANEL, query
from .cross import RET
from .ensembles import _trials
from .features import r6

#: Reviews of a log of changes: a week's orders announce names at its start, which count from three weeks on.
REVIEWS = """l AS (SELECT DISTINCT date_trunc('week', o_orderdate)::DATE AS a, n_name AS symbol, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE -1.0 END AS sign FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000),
    d AS (SELECT DISTINCT date FROM panel), v AS (SELECT DISTINCT a FROM l), s AS (SELECT a, (SELECT min(date) FROM d WHERE date >= a) AS start, (SELECT min(date) FROM d WHERE date >= a + 21) AS stop FROM v),
    rr AS (SELECT a AS review, any_value(start) AS start, any_value(stop) AS stop, count(*) AS legs, avg(sign * (q.close / p.close - 1)) - 0.002 AS net FROM l JOIN s USING (a) JOIN panel p ON p.symbol = l.symbol AND p.date = start JOIN panel q ON q.symbol = l.symbol AND q.date = stop WHERE stop > start AND p.close > 0 GROUP BY a)"""


def _reviews(spark, d):
    o, c, n = (views.table(spark, d, t) for t in ("orders", "customer", "nation"))
    log = o.where("o_totalprice > 100000").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    week = F.to_date(F.date_trunc("week", "o_orderdate"))
    log = log.select(week.alias("review"), week.alias("announced"), F.date_add(week, 21).alias("effective"), F.when(F.col("o_orderstatus") == "F", "add").otherwise("delete").alias("action"), F.col("n_name").alias("symbol"))
    return X.review_returns(exchange.review_events(log), views.panel(spark, d), 0.002)


@query("r22_review_returns", f"WITH {PANEL}, {REVIEWS} SELECT review, start, stop, legs, round(net, 6) AS net FROM rr")
def review_returns(spark, d):
    return _reviews(spark, d).select("review", "start", "stop", "legs", *r6(net=F.col("net")))


_SPREAD = "sqrt(greatest(1e-18::DOUBLE, 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr))"
_BEST = f"sqrt(v) * ({1 - V.EULER}::DOUBLE * ({normal_inverse_sql('1 - 1 / k::DOUBLE')}) + {V.EULER}::DOUBLE * ({normal_inverse_sql('1 - 1 / (k * 2.718281828459045::DOUBLE)')}))"


@query(
    "o08_review_evaluation",
    f"""WITH {PANEL}, {REVIEWS}, {RET}, u AS (SELECT review, start, net FROM rr QUALIFY row_number() OVER (PARTITION BY start ORDER BY review) = 1), g AS (SELECT net, ntile(6) OVER (ORDER BY start) - 1 AS grp FROM u),
    c AS (SELECT i, j FROM range(6) a(i), range(6) b(j) WHERE i < j), e AS (SELECT i, j, i AS grp FROM c UNION ALL SELECT i, j, j FROM c), pth AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY i, j) - 1 AS path FROM e),
    w AS (SELECT path, net FROM g JOIN pth USING (grp)), sr AS (SELECT path, avg(net) / stddev_samp(net) AS s FROM w GROUP BY path),
    o AS (SELECT count(*) AS n, count(*) / (date_diff('day', min(start), max(start)) / 365.25) AS py, avg(net) AS m, avg(net) / stddev_samp(net) AS sr FROM u),
    h AS (SELECT avg(pow(net - m, 3)) / pow(avg(pow(net - m, 2)), 1.5) AS skew, avg(pow(net - m, 4)) / pow(avg(pow(net - m, 2)), 2) AS kurtosis FROM u, o),
    t AS (SELECT count(*) AS k, var_samp(x) AS v FROM (SELECT avg(ret) / stddev_samp(ret) AS x FROM r GROUP BY symbol)), z AS (SELECT (sr - {_BEST}) * sqrt(n - 1) / {_SPREAD} AS z FROM o, h, t),
    dd AS (SELECT avg(net) / stddev_samp(net) * sqrt(count(*)) / sqrt(count(DISTINCT path)) AS t FROM w)
    SELECT any_value(n) AS events, round(any_value(py), 6) AS per_year, round(quantile_cont(s, 0.5) * sqrt(any_value(py)), 6) AS median, round(min(s) * sqrt(any_value(py)), 6) AS worst, round(avg((s < 0)::INT), 6) AS negative, count(*) AS paths,
      round(any_value({normal_cdf_sql("z")}), 6) AS deflated, round(any_value(t), 6) AS t FROM sr, o, z, dd""",
)
def review_evaluation(spark, d):
    """The reviews' returns under cross-validation of 6 groups, 2 tested; of reviews that enter on the same date the first
    counts, trials are those of the log of runs."""
    r = _reviews(spark, d).groupBy("start").agg(F.min_by(F.struct("stop", "net"), "review").alias("m")).select("start", "m.*")
    out = X.evaluated(r, 6, 2, _trials(spark, d).trials("sharpe"))
    return out.select("events", "paths", *r6(**{c: F.col(c) for c in ("per_year", "median", "worst", "negative", "deflated", "t")}))


LOOKBACKS = (5, 10, 20, 40)


def _configurations(spark, d):
    """date, strategy, ret of following or opposing the sign of returns over several lookbacks, equally over all names."""
    w = C.dated()
    p = views.panel(spark, d).withColumn("fwd", F.try_divide(F.lead("close").over(w), "close") - 1)
    out = []
    for n in LOOKBACKS:
        sign = F.signum(F.col("close") - F.lag("close", n).over(w))
        for name, side in (("follow", 1), ("oppose", -1)):
            one = p.select("date", (side * sign * F.col("fwd")).alias("r")).where("r is not null")
            out.append(one.groupBy("date").agg(F.avg("r").alias("ret")).withColumn("strategy", F.lit(f"{name} {n}")))
    both = reduce(DataFrame.unionByName, out)
    return both.withColumn("part", F.pmod(F.datediff("date", F.lit("1992-01-01")), F.lit(8)))


_CONFIGS = " UNION ALL ".join(f"SELECT date, '{name} {n}' AS strategy, avg({side} * sign(close - p{n}) * fwd) AS ret FROM q WHERE p{n} IS NOT NULL AND fwd IS NOT NULL GROUP BY date" for n in LOOKBACKS for name, side in (("follow", 1), ("oppose", -1)))
CONFIGS = f"q AS (SELECT *, lead(close) OVER w / close - 1 AS fwd, {', '.join(f'lag(close, {n}) OVER w AS p{n}' for n in LOOKBACKS)} FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)), x AS ({_CONFIGS})"


@query(
    "o12_panel_evidence",
    f"""WITH {PANEL}, {CONFIGS}, m AS (SELECT strategy, count(ret) AS n, avg(ret) AS m, avg(ret) / stddev_samp(ret) AS sr FROM x GROUP BY strategy), t AS (SELECT count(*) AS k, var_samp(sr) AS v FROM m), b AS (SELECT * FROM m ORDER BY sr DESC, strategy DESC LIMIT 1),
    h AS (SELECT avg(pow(ret - m, 3)) / pow(avg(pow(ret - m, 2)), 1.5) AS skew, avg(pow(ret - m, 4)) / pow(avg(pow(ret - m, 2)), 2) AS kurtosis FROM x JOIN b USING (strategy)), z AS (SELECT (sr - {_BEST}) * sqrt(n - 1) / {_SPREAD} AS z FROM b, h, t),
    s AS (SELECT strategy, date_diff('day', DATE '1992-01-01', date) % 8 AS part, count(ret) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM x GROUP BY ALL),
    c AS (SELECT i FROM range(256) t(i) WHERE bit_count(i::UTINYINT) = 4), io AS (SELECT i, strategy, (i >> part) & 1 AS inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM s, c GROUP BY ALL),
    sr AS (SELECT i, strategy, inside, s / n / sqrt((q - s * s / n) / (n - 1)) AS sr FROM io), top AS (SELECT i, arg_max(strategy, sr) AS strategy FROM sr WHERE inside = 1 GROUP BY i),
    rk AS (SELECT i, strategy, rank() OVER (PARTITION BY i ORDER BY sr) / (count(*) OVER (PARTITION BY i) + 1)::DOUBLE AS share FROM sr WHERE inside = 0), p AS (SELECT avg((share <= 0.5)::INT) AS pbo FROM rk JOIN top USING (i, strategy))
    SELECT k AS trials, round(v, 6) AS variance, strategy AS best, round(sr, 6) AS sharpe, round({normal_cdf_sql("z")}, 6) AS deflated, round(pbo, 6) AS pbo FROM b, t, z, p""",
)
def panel_evidence(spark, d):
    out = X.panel_evidence(_configurations(spark, d).select("strategy", "part", "ret"), 8)
    return out.select("trials", "best", *r6(variance=F.col("variance"), sharpe=F.col("sharpe"), deflated=F.col("deflated"), pbo=F.col("pbo")))


def _follow(w):
    """The sign of the return before."""
    return F.signum(F.lag("ret").over(w))


@query("r29_shuffled_control")
def shuffled_control(spark, d):
    """What following the last return's sign earns on every symbol's returns in 20 random orders."""
    r = views.bars(spark, d).withColumn("ret", B.log_return())
    return X.shuffled_control(r, _follow, 20).select("seed", "symbol", *r6(gain=F.col("gain")))


@query("o10_robustness")
def robustness(spark, d):
    """The battery for following the last return's sign."""
    r = views.bars(spark, d).withColumn("ret", B.log_return()).where("ret is not null")
    base = r.withColumn("g", _follow(B.series()) * F.col("ret")).where("g is not null").select("symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("id"), F.col("g").alias("ret"))
    scores = [r.withColumn("g", F.signum(F.lag("ret", n).over(B.series())) * F.col("ret")).agg(F.lit(f"lag {n}").alias("variant"), F.avg("g").alias("score")) for n in (1, 2, 3)]
    rows = r.withColumn("before", F.lag("ret").over(B.series())).where("before is not null").select(F.xxhash64("symbol", "ts").alias("id"), "ret", "before")
    noisy = [E.noisy(rows, "before", 0.2, k).agg(F.lit(k).alias("seed"), F.avg(F.signum("before") * F.col("ret")).alias("score")) for k in range(3)]
    limits = {"same_sign": 0.6, "held_out": 0.0, "noise": 0.0, "drawdown": 50.0, "control": 4.0}
    out = X.battery(base, reduce(DataFrame.unionByName, scores), "lag 1", X.shuffled_control(r, _follow, 20), reduce(DataFrame.unionByName, noisy), 20, limits, 5)
    return out.select("part", *r6(value=F.col("value")), "limit", "passes")



@query("o14_composite_gate")
def composite_gate(spark, d):
    """Three combiners of five factors through the same books, costs, folds and limits."""
    combiners = {"equal": dict.fromkeys(G.FACTORS, 1.0), "weighted": {"momentum": 2.0, "low_vol": 1.0, "reversal": 0.5}, "momentum": {"momentum": 1.0}}
    out = G.verdicts(views.panel(spark, d), combiners)
    return out.select("combiner", "rebalances", *r6(**{c: F.col(c) for c in ("median", "worst", "negative", "deflated", "t", "turnover", "max_sector")}), "failed", "passes")
