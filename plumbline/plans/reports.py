"""Queries that compose others: factor gates, validation reports, synthetic controls, records read from text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import backtest
from ..operators import cross_section as C
from ..operators import hygiene as H
from ..operators import portfolio as P
from ..operators import validation as V
from ..sources import exchange as X
from ..sources import views
from .catalog import PANEL, SCORES, query
from .cross import D, RET, VOL, _with_vol
from .features import r6

GATED = f"""{PANEL}, {RET}, {VOL}, sc AS (SELECT *, lag(close, 5) OVER {D} / lag(close, 60) OVER {D} - 1 AS momentum, -(close / lag(close, 5) OVER {D} - 1) AS reversal FROM v),
    e AS (SELECT max(date) AS date FROM panel GROUP BY date_trunc('month', date)), lo AS (SELECT * FROM (SELECT 'momentum' AS combiner, date, symbol, close, vol, momentum AS score FROM sc UNION ALL SELECT 'reversal', date, symbol, close, vol, reversal FROM sc) SEMI JOIN e USING (date)),
    pl AS (SELECT *, row_number() OVER (PARTITION BY combiner, date ORDER BY score DESC, symbol) AS p, count(*) OVER (PARTITION BY combiner, date) AS n FROM lo WHERE score IS NOT NULL),
    ch AS (SELECT *, CASE WHEN vol > 0 THEN 1 / vol ELSE 0 END AS i FROM pl WHERE p <= greatest(1, round_even(n * 0.4, 0))), wt AS (SELECT combiner, date, symbol, coalesce(i / nullif(sum(i) OVER (PARTITION BY combiner, date), 0), 0) AS w FROM ch),
    gr AS (SELECT k.combiner, d.date, s.symbol, coalesce(w, 0) AS w, l.close FROM (SELECT DISTINCT combiner FROM lo) k CROSS JOIN (SELECT DISTINCT date FROM lo) d CROSS JOIN (SELECT DISTINCT symbol FROM lo) s LEFT JOIN lo l ON l.combiner = k.combiner AND l.date = d.date AND l.symbol = s.symbol LEFT JOIN wt ON wt.combiner = k.combiner AND wt.date = d.date AND wt.symbol = s.symbol),
    mv AS (SELECT *, w - coalesce(lag(w) OVER q, 0) AS dw, coalesce(lead(close) OVER q / close - 1, 0) AS r FROM gr WINDOW q AS (PARTITION BY combiner, symbol ORDER BY date)),
    nt AS (SELECT combiner, date, sum(w * r) - 0.0022 * sum(abs(dw)) AS net, sum(abs(dw)) AS turnover FROM mv GROUP BY combiner, date),
    st AS (SELECT combiner, count(*) AS n, avg(net) / stddev_samp(net) AS ratio, avg(turnover) AS turnover FROM nt GROUP BY combiner)"""


def _combiners(spark, d):
    """combiner, date, net, turnover of monthly books of two scores' best names."""
    panel = views.panel(spark, d)
    scored = _with_vol(spark, d).withColumns({"momentum": C.momentum(60, 5), "reversal": C.reversal(5)}).join(C.month_ends(panel), "date", "left_semi")

    def one(name):
        chosen = C.top_share(scored.withColumn("score", F.col(name)), 0.4).select("date", "symbol", P.inverse_vol().alias("weight"))
        book = scored.select("date", "symbol", "close").join(chosen, ["date", "symbol"], "left")
        return backtest.rebalanced(book, 0.0022).select(F.lit(name).alias("combiner"), "date", "net", "turnover")

    return reduce(lambda a, b: a.unionByName(b), map(one, ("momentum", "reversal")))


@query(
    "o14_factor_gate",
    f"""WITH {GATED} SELECT combiner, n, round(ratio, 6) AS ratio, round(turnover, 6) AS turnover, concat_ws(',', CASE WHEN NOT n >= 60 THEN 'enough' END, CASE WHEN NOT ratio > 0.6 THEN 'ratio' END, CASE WHEN NOT turnover < 1.2 THEN 'turnover' END) AS failed FROM st""",
)
def factor_gate(spark, d):
    s = _combiners(spark, d).groupBy("combiner").agg(F.count("*").alias("n"), V.sharpe("net").alias("ratio"), F.avg("turnover").alias("turnover"))
    out = V.gate(s, {"enough": F.col("n") >= 60, "ratio": F.col("ratio") > 0.6, "turnover": F.col("turnover") < 1.2})
    return out.select("combiner", "n", *r6(ratio=F.col("ratio"), turnover=F.col("turnover")), "failed")


SPLIT = "c(split, grp, path) AS (VALUES (0, 0, 0), (0, 1, 0), (1, 0, 1), (1, 2, 0), (2, 0, 2), (2, 3, 0), (3, 1, 1), (3, 2, 1), (4, 1, 2), (4, 3, 1), (5, 2, 2), (5, 3, 2))"


@query(
    "o12_validation_report",
    f"""WITH {SCORES}, x AS (SELECT id, (2 * p - 1) * (y - 0.5) - abs(2 * p - 1) * 0.01 AS net, CASE WHEN p < 0.3 THEN 'low' WHEN p < 0.7 THEN 'middle' ELSE 'high' END AS regime FROM scores),
    g AS (SELECT net, ntile(4) OVER (ORDER BY id) - 1 AS grp FROM x), {SPLIT}, p AS (SELECT path, avg(net) / stddev_samp(net) AS s FROM g JOIN c USING (grp) GROUP BY path)
    SELECT 'paths' AS part, round(quantile_cont(s, 0.5), 6) AS value, count(*) AS n FROM p UNION ALL SELECT 'regime ' || regime, round(avg(net), 6), count(*) FROM x GROUP BY regime
    UNION ALL SELECT 'walk ' || grp, round(avg(net), 6), count(*) FROM g GROUP BY grp UNION ALL SELECT 'profit factor', round(sum(greatest(net, 0)) / -sum(least(net, 0)), 6), count(*) FROM x""",
)
def validation_report(spark, d):
    """Parts of a report on net returns: paths, regimes, walk forward, profit factor."""
    p = F.col("p")
    x = views.scores(spark, d).select(
        "id", ((2 * p - 1) * (F.col("y") - 0.5) - F.abs(2 * p - 1) * 0.01).alias("ret"), F.when(p < 0.3, "low").when(p < 0.7, "middle").otherwise("high").alias("regime")
    )
    groups = V.dealt_groups(x, 4, ["id"])
    paths = V.path_distribution(groups.join(F.broadcast(V.combinatorial_splits(spark, 4, 2)), "grp").select("path", "ret"))
    parts = [
        paths.select(F.lit("paths").alias("part"), F.col("median").alias("value"), F.col("paths").alias("n")),
        x.groupBy(F.concat(F.lit("regime "), "regime").alias("part")).agg(F.avg("ret").alias("value"), F.count("*").alias("n")),
        groups.groupBy(F.concat(F.lit("walk "), F.col("grp").cast("string")).alias("part")).agg(F.avg("ret").alias("value"), F.count("*").alias("n")),
        x.agg(F.lit("profit factor").alias("part"), V.profit_factor("ret").alias("value"), F.count("*").alias("n")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).select("part", F.round("value", 6).alias("value"), "n")


@query(
    "o02_members_from_text",
    "WITH m AS (SELECT o_custkey AS symbol, min(o_orderdate)::DATE AS a, CASE WHEN count(*) > 2 THEN max(o_orderdate)::DATE END AS b FROM orders GROUP BY o_custkey) SELECT symbol::VARCHAR AS symbol FROM m WHERE a <= DATE '1999-03-31' AND (b IS NULL OR DATE '1999-03-31' <= b)",
)
def members_from_text(spark, d):
    """Memberships as records of text, an empty end being an open one."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = views.table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("symbol")).agg(F.min(day).alias("start"), F.when(F.count("*") > 2, F.max(day)).otherwise("").alias("end"))
    return H.members_on(H.memberships(raw), F.lit("1999-03-31").cast("date"))


@query(
    "s32_chart_closes",
    "SELECT user_id::VARCHAR AS symbol, event_id AS ts, value AS close FROM events WHERE event_id % 5 <> 4",
)
def chart_closes(spark, d):
    """Charts as JSON, a row for each symbol with arrays of times and closes; closes that are null are no rows."""
    e = views.table(spark, d, "events").withColumn("close", F.when(F.col("event_id") % 5 != 4, F.col("value")))
    points = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "close"))).alias("x"))
    raw = points.select(F.to_json(F.struct(F.col("user_id").cast("string").alias("symbol"), F.col("x.event_id").alias("timestamp"), F.col("x.close").alias("close")), {"ignoreNullFields": "false"}).alias("value"))
    return X.chart_closes(raw)
