"""Queries of event studies and small projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import series
from ..operators import bars as B
from ..operators import cross_section as C
from ..operators import events as E
from ..operators import models as M
from ..sources import archive, views
from .catalog import BARS, PANEL, SCORES, query
from .features import r6


@query("p10_surprise", "SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN sign(value - 0) ELSE (value - event_id % 5 * 37) / abs(event_id % 5 * 37) END, 6) AS surprise FROM events")
def surprise(spark, d):
    return views.table(spark, d, "events").select("event_id", *r6(surprise=E.surprise(F.col("value"), (F.col("event_id") % 5 * 37).cast("double"))))


@query(
    "p09_drift_strategy",
    f"""WITH {BARS}, s AS (SELECT *, (close - open) / abs(open) AS s, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS drift FROM bars)
    SELECT symbol, ts, ts + INTERVAL 5 DAY AS t1, round(sign(s) * drift - 0.002, 6) AS net FROM s WHERE abs(s) >= 0.5 AND drift IS NOT NULL""",
)
def drift_strategy(spark, d):
    s = views.bars(spark, d).withColumns({"s": E.surprise(F.col("close"), F.col("open")), "drift": F.try_divide(F.lead("close", 5).over(series()), "close") - 1})
    kept = s.where("abs(s) >= 0.5 and drift is not null")
    return kept.select("symbol", "ts", F.expr("ts + interval 5 days").alias("t1"), *r6(net=F.signum("s") * F.col("drift") - 0.002))


@query("p11_net_returns", f"WITH {SCORES} SELECT id, round((2 * p - 1) * (y - 0.5) - abs(2 * p - 1) * 0.01, 6) AS net FROM scores")
def net_returns(spark, d):
    return views.scores(spark, d).select("id", *r6(net=E.net_position_return(E.position_of(F.col("p")), F.col("y") - 0.5, 0.01)))


@query("p15_fund_costs", "SELECT p_partkey, round(p_retailprice * 0.0011 + p_retailprice * 0.0004 / 2 + CASE WHEN p_size > 25 THEN 15.93 ELSE 0 END, 8) AS cost FROM part")
def fund_costs(spark, d):
    return views.table(spark, d, "part").select("p_partkey", F.round(E.trade_cost(F.col("p_retailprice"), F.col("p_size") > 25, 0.0011, 0.0004, 15.93), 8).alias("cost"))


@query("k05_newest_bars", f"WITH {BARS} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 20")
def newest_bars(spark, d):
    return archive.newest(views.bars(spark, d), 20)


@query(
    "j11_grid_alignment",
    f"""WITH {BARS}, c AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2024-01-01') AS ts, arg_max(close, ts) AS close FROM bars GROUP BY ALL)
    SELECT c.symbol, c.ts, c.close, f.close AS fine FROM c LEFT JOIN bars f ON f.symbol = c.symbol AND f.ts = c.ts + INTERVAL 3 HOUR""",
)
def grid_alignment(spark, d):
    b = views.bars(spark, d)
    coarse = B.coarser(b, "4 hours").select("symbol", "ts", "close")
    fine = b.select("symbol", F.expr("ts - interval 3 hours").alias("ts"), F.col("close").alias("fine"))
    return coarse.join(fine, ["symbol", "ts"], "left")


@query("r12_buy_and_hold", f"WITH {PANEL} SELECT date, symbol, round(100 * close / first_value(close) OVER (PARTITION BY symbol ORDER BY date), 6) AS equity FROM panel")
def buy_and_hold(spark, d):
    return views.panel(spark, d).select("date", "symbol", *r6(equity=100 * F.try_divide("close", F.first("close").over(C.dated()))))


@query(
    "r15_risk_parity",
    f"""WITH {PANEL}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM panel),
    v AS (SELECT *, CASE WHEN count(ret) OVER q = 20 THEN stddev_samp(ret) OVER q END * sqrt(252) AS vol FROM r WINDOW q AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    e AS (SELECT max(date) AS date FROM panel GROUP BY date_trunc('month', date)), x AS (SELECT v.* FROM v SEMI JOIN e USING (date) WHERE vol > 0)
    SELECT date, symbol, round(1 / vol / sum(1 / vol) OVER (PARTITION BY date) * least(1, 5.0 / avg(vol) OVER (PARTITION BY date)), 6) AS weight FROM x""",
)
def risk_parity(spark, d):
    from ..functions.columns import rolling
    from ..operators.portfolio import inverse_vol

    p = views.panel(spark, d).withColumn("ret", C.daily_return())
    p = p.withColumn("vol", F.sqrt(F.lit(252.0)) * rolling(F.stddev_samp("ret"), "ret", 20, C.dated()))
    ends = p.join(C.month_ends(p), "date", "left_semi").where("vol > 0")
    scale = F.least(F.lit(1.0), 5.0 / F.avg("vol").over(C.on_date()))
    return ends.select("date", "symbol", *r6(weight=inverse_vol() * scale))


INDEX_CHANGES = f"""WITH {PANEL}, ch AS (SELECT o_orderkey AS review, n_name AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS sign, o_orderdate::DATE AS a, o_orderdate::DATE + 30 AS b
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    e AS (SELECT ch.*, p.close AS pa FROM ch ASOF JOIN panel p ON ch.symbol = p.symbol AND ch.a <= p.date), f AS (SELECT e.*, p.close AS pb FROM e ASOF JOIN panel p ON e.symbol = p.symbol AND e.b <= p.date)
    SELECT sign AS review, count(*) AS legs, round(avg(sign * (pb / pa - 1)) - 0.002, 6) AS net FROM f GROUP BY sign"""


@query("r22_index_changes", INDEX_CHANGES)
def index_changes(spark, d):
    o, c, n = (views.table(spark, d, t) for t in ("orders", "customer", "nation"))
    ch = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    sign = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    ch = ch.select(sign.alias("review"), F.col("n_name").alias("symbol"), sign.alias("sign"), F.to_date("o_orderdate").alias("announced"), F.date_add("o_orderdate", 30).alias("effective"))
    out = E.basket_returns(ch, views.panel(spark, d), 0.002)
    return out.select("review", "legs", *r6(net=F.col("net")))


EVENT_WINDOWS = f"""WITH {BARS}, st AS (SELECT symbol, ts, close / lag(close, 3) OVER w - 1 AS pre, lead(close) OVER w / close - 1 AS reaction, lead(close, 6) OVER w / lead(close) OVER w - 1 AS drift FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    ev AS (SELECT event_id, event_type AS symbol, ts FROM events)
    SELECT event_id, round(pre, 6) AS pre, round(reaction, 6) AS reaction, round(drift, 6) AS drift FROM ev ASOF LEFT JOIN st ON ev.symbol = st.symbol AND ev.ts >= st.ts"""


@query("r26_event_windows", EVENT_WINDOWS)
def event_windows(spark, d):
    ev = views.table(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), "ts")
    out = E.event_windows(ev, views.bars(spark, d), 3, 5)
    return out.select("event_id", *r6(pre=F.col("pre"), reaction=F.col("reaction"), drift=F.col("drift")))


@query("r27_shuffled_drawdowns")
def shuffled_drawdowns(spark, d):
    """Of every symbol."""
    r = views.bars(spark, d).withColumn("ret", B.log_return()).where("ret is not null")
    r = r.select("symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("id"), "ret")
    return E.shuffled_drawdowns(r, 50, 7, ("symbol",)).select("symbol", "path", *r6(drawdown=F.col("drawdown")))


@query("r28_noise")
def noise(spark, d):
    return E.noisy(views.scores(spark, d), "p", 0.1, 3).select("id", "p")


@query("m07_permutation_importance")
def permutation_importance(spark, d):
    s = M.standardised(views.scores(spark, d).withColumn("q", (F.col("id") % 7).cast("double")), ["p", "q"])
    beta = M.fit_logistic(s, ["p", "q"], rounds=5)
    return E.permutation_importance(s, ["p", "q"], lambda _: M.probability(["p", "q"], beta))


@query(
    "r14_excess_returns",
    f"""WITH {PANEL}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM panel), m AS (SELECT date, avg(ret) AS m FROM r GROUP BY date)
    SELECT date, symbol, round(ret - m, 6) AS excess FROM r JOIN m USING (date) WHERE ret IS NOT NULL""",
)
def excess_returns(spark, d):
    r = views.panel(spark, d).withColumn("ret", C.daily_return())
    m = r.groupBy("date").agg(F.avg("ret").alias("m"))
    return r.where("ret is not null").join(m, "date").select("date", "symbol", *r6(excess=F.col("ret") - F.col("m")))


@query(
    "j10_overlap_purge",
    """WITH l AS (SELECT event_id, user_id, ts AS a, ts + INTERVAL 12 HOUR AS b FROM events), t AS (SELECT user_id, min(a) AS a, max(b) AS b FROM l WHERE event_id % 10 = 0 GROUP BY user_id)
    SELECT event_id FROM l JOIN t USING (user_id) WHERE event_id % 10 <> 0 AND (l.b < t.a OR l.a > t.b)""",
)
def overlap_purge(spark, d):
    l = views.table(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("a"), F.expr("ts + interval 12 hours").alias("b"))  # noqa: E741
    t = l.where("event_id % 10 = 0").groupBy("user_id").agg(F.min("a").alias("_a"), F.max("b").alias("_b"))
    return l.where("event_id % 10 <> 0").join(t, "user_id").where("b < _a or a > _b").select("event_id")


