"""Queries of event sampling, labels and label weights, and of bar backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rolling
from ..operators import backtest, bars, folds
from ..operators import labeling as L
from ..sources import views
from .catalog import BARS, gated, query
from .features import NUMBERED, RET, r6

CUSUM = f"""{BARS}, {NUMBERED}, q AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM n),
    f AS (SELECT symbol, i, 0.0::DOUBLE AS u, 0.0::DOUBLE AS d, 0 AS ev FROM q WHERE i = 1
      UNION ALL SELECT symbol, i, CASE WHEN u1 > 2 THEN 0 ELSE u1 END, CASE WHEN u1 <= 2 AND d1 < -2 THEN 0 ELSE d1 END, CASE WHEN u1 > 2 THEN 1 WHEN d1 < -2 THEN -1 ELSE 0 END
      FROM (SELECT q.symbol, q.i, greatest(0, u + r) AS u1, least(0, d + r) AS d1 FROM f JOIN q ON q.symbol = f.symbol AND q.i = f.i + 1))"""


@query("r01_cusum_events", f"WITH RECURSIVE {CUSUM} SELECT symbol, ts, ev AS event FROM n JOIN f USING (symbol, i)")
def cusum_events(spark, d):
    b = views.bars(spark, d).withColumn("ret", bars.log_return())
    return folds.cusum(b, 2.0).select("symbol", "ts", "event")


P = f"""{BARS}, r AS (SELECT *, {RET} AS r FROM bars), s AS (SELECT *, {gated('stddev_samp(r)', 'r', 10)} AS sigma, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM r),
  e AS (SELECT *, max(pos) OVER (PARTITION BY symbol, CAST(ts AS DATE)) AS fin FROM s)"""
TB = f"""{P}, v AS (SELECT *, close * (1 + greatest(0.5 * sigma, 0.05)) AS up, close * (1 - greatest(0.5 * sigma, 0.05)) AS lo, least(pos + 8, fin) AS stop FROM e WHERE sigma IS NOT NULL),
  t AS (SELECT v.symbol, v.ts, v.pos, v.close, v.stop, v.r, min(b.pos) FILTER (b.close >= up) AS a, min(b.pos) FILTER (b.close <= lo) AS z, arg_max(b.close, b.pos) AS fc
    FROM v JOIN e b ON b.symbol = v.symbol AND b.pos > v.pos AND b.pos <= v.stop GROUP BY ALL),
  l AS (SELECT *, CASE WHEN z IS NOT NULL AND (a IS NULL OR z <= a) THEN 'stop' WHEN a IS NOT NULL THEN 'profit' ELSE 'time' END AS barrier FROM t),
  o AS (SELECT *, CASE barrier WHEN 'stop' THEN z WHEN 'profit' THEN a ELSE stop END AS x, CAST(CASE barrier WHEN 'stop' THEN -1 WHEN 'profit' THEN 1 ELSE sign(fc - close) END AS INT) AS label FROM l)"""


def _labelled(spark, d):
    b = L.session_ends(views.bars(spark, d).withColumn("ret", bars.log_return()))
    events = b.withColumn("sigma", rolling(F.stddev_samp("ret"), "ret", 10))
    return b, L.triple_barrier(events.select("symbol", "ts", "pos", "close", "ret", "sigma", "end"), b, 0.5, 0.05, 8)


@query("r02_triple_barrier", f"WITH {TB} SELECT symbol, ts, barrier, label, CAST(x AS INT) AS exit FROM o")
def triple_barrier(spark, d):
    return _labelled(spark, d)[1].select("symbol", "ts", "barrier", "label", F.col("exit").cast("int").alias("exit"))


@query("r03_meta_label", f"WITH {TB} SELECT symbol, ts, CAST(CASE WHEN sign(r) <> 0 AND sign(r) * CASE WHEN barrier = 'time' THEN fc - close ELSE label END > 0 THEN 1 ELSE 0 END AS INT) AS meta FROM o")
def meta_label(spark, d):
    return L.meta_label(_labelled(spark, d)[1].withColumn("side", F.signum("ret"))).select("symbol", "ts", "meta")


@query("w34_session_ends", f"WITH {P} SELECT symbol, ts, CAST(pos AS INT) AS pos, CAST(fin AS INT) AS stop FROM e")
def session_ends(spark, d):
    return L.session_ends(views.bars(spark, d)).select("symbol", "ts", "pos", F.col("end").alias("stop"))


SPANS = f"""{TB}, g AS (SELECT symbol, pos AS id, pos AS a, x AS b FROM o), w AS (SELECT symbol, id, unnest(generate_series(a, b)) AS pos FROM g), c AS (SELECT symbol, pos, count(*) AS c FROM w GROUP BY ALL)"""


def _spans(spark, d):
    b, labelled = _labelled(spark, d)
    return b, labelled.select("symbol", F.col("pos").alias("id"), F.col("pos").alias("start"), F.col("exit").alias("stop"))


@query("a08_concurrency", f"WITH {SPANS} SELECT symbol, CAST(pos AS INT) AS pos, c FROM c")
def concurrency(spark, d):
    return L.concurrency(_spans(spark, d)[1])


@query("a09_uniqueness", f"WITH {SPANS} SELECT symbol, CAST(id AS INT) AS id, round(avg(1.0 / c), 6) AS uniqueness FROM w JOIN c USING (symbol, pos) GROUP BY ALL")
def uniqueness(spark, d):
    return L.uniqueness(_spans(spark, d)[1]).select("symbol", "id", *r6(uniqueness=F.col("uniqueness")))


@query(
    "a10_return_attribution",
    f"""WITH {SPANS}, x2 AS (SELECT w.symbol, id, abs(sum(e.r / c)) AS raw FROM w JOIN c USING (symbol, pos) JOIN e USING (symbol, pos) GROUP BY ALL)
    SELECT symbol, CAST(id AS INT) AS id, round(raw * count(*) OVER () / sum(raw) OVER (), 6) AS weight FROM x2""",
)
def return_attribution(spark, d):
    b, spans = _spans(spark, d)
    return L.return_attribution(spans, b.select("symbol", "pos", "ret")).select("symbol", "id", *r6(weight=F.col("weight")))


@query(
    "w40_time_decay",
    f"""WITH {SPANS}, u AS (SELECT symbol, id, avg(1.0 / c) AS u FROM w JOIN c USING (symbol, pos) GROUP BY ALL), k AS (SELECT *, sum(u) OVER (PARTITION BY symbol ORDER BY id ROWS UNBOUNDED PRECEDING) AS x, sum(u) OVER (PARTITION BY symbol) AS t FROM u)
    SELECT symbol, CAST(id AS INT) AS id, round(greatest(1 - 0.5 / t * t + 0.5 / t * x, 0), 6) AS decay FROM k""",
)
def time_decay(spark, d):
    return L.time_decay(L.uniqueness(_spans(spark, d)[1]), 0.5).select("symbol", "id", *r6(decay=F.col("decay")))


@query(
    "r30_pooled_clock",
    f"""WITH {BARS}, s AS (SELECT symbol, count(*) AS length FROM bars GROUP BY symbol)
    SELECT symbol, length, CAST(coalesce(sum(length + 24) OVER (ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM s""",
)
def pooled_clock(spark, d):
    return L.pooled_clock(views.bars(spark, d).groupBy("symbol").agg(F.count("*").alias("length")), 24)


HELD = f"""{BARS}, t AS (SELECT *, CASE WHEN hour(ts) % 3 = 0 THEN CAST(10 * sign(close - open) AS INT) END AS target FROM bars),
  q AS (SELECT *, coalesce(last_value(target IGNORE NULLS) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS dec FROM t),
  h AS (SELECT *, CASE WHEN lead(ts) OVER z IS NULL THEN 0 ELSE coalesce(lag(dec) OVER z, 0) END AS held FROM q WINDOW z AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts))"""


def _held(spark, d):
    target = F.when(F.hour("ts") % 3 == 0, (10 * F.signum(F.col("close") - F.col("open"))).cast("int"))
    return backtest.holdings(views.bars(spark, d), target)


@query("w41_holdings", f"WITH {HELD} SELECT symbol, ts, held FROM h")
def holdings(spark, d):
    return _held(spark, d).select("symbol", "ts", "held")


@query(
    "r09_equity",
    f"""WITH {HELD}, m AS (SELECT *, held - coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY ts), 0) AS dl FROM h),
    k AS (SELECT *, open * abs(dl) AS t, least(open * abs(dl) * 0.0003, 20) AS b FROM m),
    c AS (SELECT *, CASE WHEN dl <> 0 THEN b + CASE WHEN dl > 0 THEN t * 0.00003 ELSE t * 0.00025 END + t * 0.0000297 + t * 0.000001 + (b + t * 0.0000297 + t * 0.000001) * 0.18 ELSE 0 END AS cost FROM k),
    s AS (SELECT *, 100000 + sum(-open * dl - cost) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cash FROM c)
    SELECT symbol, ts, round(cash, 5) AS cash, round(cash + held * close, 5) AS equity FROM s""",
)
def equity(spark, d):
    return backtest.equity(_held(spark, d), 100_000.0).select("symbol", "ts", F.round("cash", 5).alias("cash"), F.round("equity", 5).alias("equity"))
