"""Queries across symbols: ranks, factors, universes, books, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rolling
from ..operators import cross_section as C
from ..operators import portfolio as P
from ..operators.folds import held_weights
from ..sources import views
from .catalog import PANEL, frame, query
from .catalog import gated as _gated
from .features import r6


def gated(aggregate: str, x: str, n: int) -> str:
    return _gated(aggregate, x, n, order="date")


D = "(PARTITION BY symbol ORDER BY date)"
RET = f"r AS (SELECT *, close / lag(close) OVER {D} - 1 AS ret FROM panel)"


def rank_sql(x: str, by: str = "date") -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by})"


@query("panel_view", f"WITH {PANEL} SELECT * FROM panel")
def panel_view(spark, d):
    return views.panel(spark, d)


@query("c01_centred_rank", f"WITH {PANEL} SELECT date, symbol, round({rank_sql('close')} - 0.5, 6) AS r FROM panel")
def centred_rank(spark, d):
    return views.panel(spark, d).select("date", "symbol", *r6(r=C.centred_rank("close")))


@query(
    "c02_sector_zscore",
    f"WITH {PANEL} SELECT date, symbol, round((close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0), 6) AS z FROM panel WINDOW w AS (PARTITION BY date, sector)",
)
def sector_zscore(spark, d):
    return views.panel(spark, d).select("date", "symbol", *r6(z=C.sector_zscore("close")))


@query("c03_decile", f"WITH {PANEL} SELECT date, symbol, CAST(least(greatest(ceil(round({rank_sql('close')} * 10, 9)) - 1, 0), 9) AS INT) AS decile FROM panel")
def decile(spark, d):
    return views.panel(spark, d).select("date", "symbol", C.bucket("close", 10).alias("decile"))


@query(
    "c04_composite",
    f"""WITH {PANEL}, z AS (SELECT *, (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) AS a,
      (volume - avg(volume) OVER w) / nullif(stddev_samp(volume) OVER w, 0) AS b FROM panel WINDOW w AS (PARTITION BY date, sector))
    SELECT date, symbol, round((coalesce(2 * a, 0) - coalesce(b, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 2 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END, 0), 6) AS score FROM z""",
)
def composite(spark, d):
    z = views.panel(spark, d).withColumns({"a": C.sector_zscore("close"), "b": C.sector_zscore(F.col("volume"))})
    return z.select("date", "symbol", *r6(score=C.composite({"a": 2.0, "b": -1.0})))


@query("c05_above_median", f"WITH {PANEL} SELECT date, symbol, CAST(close >= quantile_cont(close, 0.5) OVER (PARTITION BY date) AS INT) AS label FROM panel")
def above_median(spark, d):
    return views.panel(spark, d).select("date", "symbol", (F.col("close") >= F.percentile("close", F.lit(0.5)).over(C.on_date())).cast("int").alias("label"))


@query(
    "c07_cross_sectional_labels",
    f"""WITH {PANEL}, f AS (SELECT *, lead(close, 21) OVER {D} / close - 1 AS fwd, lead(date, 21) OVER {D} AS t1 FROM panel), k AS (SELECT * FROM f WHERE volume >= 20)
    SELECT date, symbol, round(fwd, 6) AS fwd, t1, CASE WHEN fwd IS NOT NULL THEN CAST(least(greatest(ceil(round(
      (rank() OVER (PARTITION BY date ORDER BY fwd NULLS LAST) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0) / count(fwd) OVER (PARTITION BY date) * 10, 9)) - 1, 0), 9) AS INT) END AS decile FROM k""",
)
def cross_sectional_labels(spark, d):
    f = views.panel(spark, d).withColumns({"fwd": C.forward_return(21), "t1": F.lead("date", 21).over(C.dated())})
    return f.where("volume >= 20").select("date", "symbol", F.round("fwd", 6).alias("fwd"), "t1", C.bucket("fwd", 10).alias("decile"))


@query("w23_momentum", f"WITH {PANEL} SELECT date, symbol, round(lag(close, 21) OVER {D} / lag(close, 252) OVER {D} - 1, 6) AS x FROM panel")
def momentum(spark, d):
    return views.panel(spark, d).select("date", "symbol", *r6(x=C.momentum(252, 21)))


@query("w24_reversal", f"WITH {PANEL} SELECT date, symbol, round(-(close / lag(close, 21) OVER {D} - 1), 6) AS x FROM panel")
def reversal(spark, d):
    return views.panel(spark, d).select("date", "symbol", *r6(x=C.reversal(21)))


@query("w25_low_volatility", f"WITH {PANEL}, {RET} SELECT date, symbol, round(-{gated('stddev_samp(ret)', 'ret', 252)}, 6) AS x FROM r")
def low_volatility(spark, d):
    return views.panel(spark, d).withColumn("ret", C.daily_return()).select("date", "symbol", *r6(x=C.low_volatility(252)))


@query("w26_illiquidity", f"WITH {PANEL}, {RET}, i AS (SELECT *, 1e6 * abs(ret) / nullif(value, 0) AS x FROM r) SELECT date, symbol, round({gated('avg(x)', 'x', 252)}, 6) AS x FROM i")
def illiquidity(spark, d):
    p = views.panel(spark, d).withColumn("ret", C.daily_return())
    return p.select("date", "symbol", *r6(x=1e6 * C.illiquidity(252)))


@query(
    "w27_residual_momentum",
    f"""WITH {PANEL}, {RET}, m AS (SELECT *, avg(ret) OVER (PARTITION BY date) AS market FROM r),
    f AS (SELECT *, {gated('covar_samp(ret, market)', 'ret', 60)} / nullif({gated('var_samp(market)', 'ret', 60)}, 0) AS b FROM (SELECT *, CASE WHEN ret IS NOT NULL THEN market END AS market2 FROM m) x),
    g AS (SELECT *, {gated('avg(ret)', 'ret', 60)} - b * {gated('avg(market2)', 'ret', 60)} AS a FROM f),
    e AS (SELECT *, ret - (lag(a) OVER {D} + lag(b) OVER {D} * market) AS e FROM g),
    s AS (SELECT *, {gated('sum(e)', 'e', 50)} AS s FROM e) SELECT date, symbol, round(lag(s, 10) OVER {D}, 3) AS x FROM s""".replace(
        "covar_samp(ret, market)", "covar_samp(ret, market2)"
    ).replace("var_samp(market)", "var_samp(market2)"),
)
def residual_momentum(spark, d):
    p = views.panel(spark, d).withColumn("ret", C.daily_return()).withColumn("market", F.avg("ret").over(C.on_date()))
    return C.residual_momentum(p, 60, 10).select("date", "symbol", F.round("residual_momentum", 3).alias("x"))


@query("w28_average_daily_value", f"WITH {PANEL} SELECT date, symbol, round(CASE WHEN count(value) OVER {frame(126, order='date')} >= 63 THEN quantile_cont(value, 0.5) OVER {frame(126, order='date')} END, 4) AS adv FROM panel")
def average_daily_value(spark, d):
    return views.panel(spark, d).select("date", "symbol", F.round(C.average_daily_value(126), 4).alias("adv"))


DENSE = "dense AS (SELECT d.date, s.symbol, s.sector, close, volume, value FROM (SELECT DISTINCT date FROM panel) d CROSS JOIN (SELECT DISTINCT symbol, sector FROM panel) s LEFT JOIN panel USING (date, symbol))"


@query("w32_forward_return", f"WITH {PANEL}, {DENSE} SELECT date, symbol, round(lead(close, 21) OVER {D} / close - 1, 6) AS fwd FROM dense")
def forward_return(spark, d):
    return C.dense(views.panel(spark, d)).select("date", "symbol", *r6(fwd=C.forward_return(21)))


@query("w33_month_ends", f"WITH {PANEL} SELECT max(date) AS date FROM panel GROUP BY date_trunc('month', date)")
def month_ends(spark, d):
    return C.month_ends(views.panel(spark, d))


@query(
    "w37_split_adjusted",
    f"""WITH {PANEL}, {DENSE}, ev AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, n_name AS symbol FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'),
    m AS (SELECT dense.*, ev.date IS NOT NULL AS event, close / lag(close) OVER (PARTITION BY dense.symbol ORDER BY dense.date) AS step FROM dense LEFT JOIN ev ON ev.date = dense.date AND ev.symbol = dense.symbol),
    f AS (SELECT *, CASE WHEN event AND step > 0 AND step < 0.98 THEN step ELSE 1.0 END AS f FROM m)
    SELECT date, symbol, round(close * exp(coalesce(sum(ln(f)) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) + 1e-9, 6) AS adj_close FROM f WHERE close IS NOT NULL""",
)
def split_adjusted(spark, d):
    orders, customer, nation = (views.table(spark, d, t) for t in ("orders", "customer", "nation"))
    ev = orders.where("o_orderpriority = '1-URGENT'").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    ev = ev.select(F.to_date("o_orderdate").alias("date"), F.col("n_name").alias("symbol"))
    return C.split_adjusted(C.dense(views.panel(spark, d)), ev).where("close is not null").select("date", "symbol", *r6(adj_close=F.col("adj_close") + 1e-9))  # off the halves that prices over quantities hit


@query(
    "k01_top_share",
    f"""WITH {PANEL}, p AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY close DESC, symbol) AS p, count(*) OVER (PARTITION BY date) AS n FROM panel)
    SELECT date, symbol FROM p WHERE p <= greatest(1, round_even(n * 0.2, 0))""",
)
def top_share(spark, d):
    return C.top_share(views.panel(spark, d), 0.2, "close").select("date", "symbol")


@query(
    "k02_liquidity_universe",
    f"""WITH {PANEL}, a AS (SELECT *, CASE WHEN count(value) OVER {frame(60, order='date')} >= 30 THEN quantile_cont(value, 0.5) OVER {frame(60, order='date')} END AS adv,
      count(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS traded FROM panel),
    e AS (SELECT max(date) AS date FROM panel GROUP BY date_trunc('month', date)),
    k AS (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY adv DESC, symbol) AS place FROM a SEMI JOIN e USING (date) WHERE adv IS NOT NULL AND traded >= 50)
    SELECT date, symbol, CAST(place AS INT) AS place FROM k WHERE place <= 5""",
)
def liquidity_universe(spark, d):
    return C.liquidity_universe(views.panel(spark, d), 5, 60, 50).select("date", "symbol", "place")


VOL = f"v AS (SELECT *, {gated('stddev_samp(ret)', 'ret', 20)} AS vol FROM r)"


def _with_vol(spark, d):
    return views.panel(spark, d).withColumn("ret", C.daily_return()).withColumn("vol", rolling(F.stddev_samp("ret"), "ret", 20, C.dated()))


@query(
    "r16_inverse_vol_weights",
    f"""WITH {PANEL}, {RET}, {VOL}, x AS (SELECT *, CASE WHEN vol > 0 THEN 1 / vol ELSE 0 END AS i FROM v)
    SELECT date, symbol, round(coalesce(i / nullif(sum(i) OVER (PARTITION BY date), 0), 0), 6) AS weight FROM x""",
)
def inverse_vol_weights(spark, d):
    return _with_vol(spark, d).select("date", "symbol", *r6(weight=P.inverse_vol()))


CAPS = """c AS (SELECT *, least(w, 0.1) AS cut FROM book), t AS (SELECT *, sum(cut) OVER (PARTITION BY date, sector) AS tot FROM c)"""
BOOK = f"x AS (SELECT *, CASE WHEN vol > 0 THEN 1 / vol ELSE 0 END AS i FROM v), book AS (SELECT *, coalesce(i / nullif(sum(i) OVER (PARTITION BY date), 0), 0) AS w FROM x)"


@query("r18_capped_book", f"WITH {PANEL}, {RET}, {VOL}, {BOOK}, {CAPS} SELECT date, symbol, round(CASE WHEN tot > 0.25 THEN cut * (0.25 / tot) ELSE cut END, 6) AS weight FROM t")
def capped_book(spark, d):
    book = _with_vol(spark, d).withColumn("weight", P.inverse_vol())
    return P.capped(book, 0.1, 0.25).select("date", "symbol", *r6(weight=F.col("weight")))


@query(
    "r19_construct_book",
    f"""WITH {PANEL}, {RET}, {VOL}, s AS (SELECT *, lag(close, 5) OVER {D} / lag(close, 60) OVER {D} - 1 AS score FROM v),
    p AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS p, count(*) OVER (PARTITION BY date) AS n FROM s WHERE score IS NOT NULL),
    k AS (SELECT * FROM p WHERE p <= greatest(1, round_even(n * 0.4, 0))), x AS (SELECT *, CASE WHEN vol > 0 THEN 1 / vol ELSE 0 END AS i FROM k),
    book AS (SELECT *, coalesce(i / nullif(sum(i) OVER (PARTITION BY date), 0), 0) AS w FROM x), {CAPS}
    SELECT panel.date, panel.symbol, round(coalesce(CASE WHEN tot > 0.25 THEN cut * (0.25 / tot) ELSE cut END, 0), 6) AS weight FROM panel LEFT JOIN t USING (date, symbol)""",
)
def construct_book(spark, d):
    return book_of(spark, d).select("date", "symbol", *r6(weight=F.col("weight")))


def book_of(spark, d):
    """Momentum names, inverse-volatility weights, caps, 0 for the rest of the panel."""
    scored = _with_vol(spark, d).withColumn("score", C.momentum(60, 5))
    chosen = C.top_share(scored, 0.4).withColumn("weight", P.inverse_vol())
    capped = P.capped(chosen, 0.1, 0.25).select("date", "symbol", F.col("weight").alias("_w"))
    return scored.join(capped, ["date", "symbol"], "left").withColumn("weight", F.coalesce("_w", F.lit(0.0))).drop("_w")


@query(
    "a24_max_sector_weight",
    f"""WITH {PANEL}, {RET}, {VOL}, {BOOK}, s AS (SELECT date, sector, sum(w) AS w FROM book GROUP BY date, sector) SELECT date, round(max(w), 6) AS top FROM s GROUP BY date""",
)
def max_sector_weight(spark, d):
    book = _with_vol(spark, d).withColumn("weight", P.inverse_vol())
    return book.groupBy("date", "sector").agg(F.sum("weight").alias("w")).groupBy("date").agg(F.round(F.max("w"), 6).alias("top"))


@query("a25_market_return", f"WITH {PANEL}, {RET} SELECT date, round(avg(ret), 6) AS market FROM r GROUP BY date")
def market_return(spark, d):
    return views.panel(spark, d).withColumn("ret", C.daily_return()).groupBy("date").agg(F.round(F.avg("ret"), 6).alias("market"))


@query(
    "a26_position_overlap",
    f"""WITH {PANEL}, a AS (SELECT date, symbol FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY close DESC, symbol) AS p FROM panel) WHERE p <= 5),
    b AS (SELECT date, symbol FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume DESC, symbol) AS p FROM panel) WHERE p <= 5),
    j AS (SELECT date, count(a.symbol) FILTER (b.symbol IS NOT NULL) AS both_, count(*) AS any_ FROM a FULL JOIN b USING (date, symbol) GROUP BY date)
    SELECT round(avg(both_::DOUBLE / any_), 6) AS overlap, count(*) AS dates FROM j""",
)
def position_overlap(spark, d):
    p = views.panel(spark, d)
    a, b = (p.withColumn("p", F.row_number().over(C.on_date().orderBy(F.desc(x), "symbol"))).where("p <= 5").groupBy("date").agg(F.collect_set("symbol").alias(x)) for x in ("close", "volume"))
    j = a.join(b, "date").select((F.size(F.array_intersect("close", "volume")) / F.size(F.array_union("close", "volume"))).alias("j"))
    return j.agg(F.round(F.avg("j"), 6).alias("overlap"), F.count("*").alias("dates"))


@query(
    "j13_correlated_pairs",
    f"""WITH {PANEL}, {RET} SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(corr(a.ret, b.ret), 6) AS corr
    FROM r a JOIN r b ON a.date = b.date AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY ALL HAVING count(*) > 30 AND corr(a.ret, b.ret) > 0""",
)
def correlated_pairs(spark, d):
    pairs = C.correlations(views.panel(spark, d).withColumn("ret", C.daily_return()))
    return pairs.where("n > 30 and corr > 0").withColumn("corr", F.round("corr", 6))


@query("r17_hierarchical_book")
def hierarchical_book(spark, d):
    p = views.panel(spark, d).withColumn("ret", C.daily_return()).where("ret is not null").withColumn("month", F.trunc("date", "MM"))
    p = p.withColumn("date", F.trunc("date", "YEAR")).select("date", "symbol", F.col("month"), "ret")
    monthly = p.groupBy("date", "month", "symbol").agg(F.avg("ret").alias("ret"))
    a, b = (monthly.select("date", "month", F.col("symbol").alias(x), F.col("ret").alias(f"r{x}")) for x in "ab")
    cov = a.join(b, ["date", "month"]).groupBy("date", "a", "b").agg(F.covar_samp("ra", "rb").alias("cov"))
    return P.hierarchical_book(cov).select("date", "symbol", *r6(weight=F.col("weight")))


FILLS = "fills AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_extendedprice / l_quantity AS price, l_quantity AS qty FROM lineitem)"


@query(
    "p13_fill_costs",
    f"""WITH {FILLS}, t AS (SELECT *, price * qty AS t, least(price * qty * 0.0003, 20) AS b FROM fills)
    SELECT l_orderkey, l_linenumber, l_partkey, round(b, 12) AS brokerage, round(b + CASE WHEN side = 'sell' THEN t * 0.00025 ELSE t * 0.00003 END + t * 0.0000297 + t * 0.000001 + (b + t * 0.0000297 + t * 0.000001) * 0.18, 12) AS total FROM t""",
)
def fill_costs(spark, d):
    f = _fills(spark, d).withColumn("c", P.fill_cost(F.col("side"), F.col("price"), F.col("qty")))
    return f.select("l_orderkey", "l_linenumber", "l_partkey", F.round("c.brokerage", 12).alias("brokerage"), F.round("c.total", 12).alias("total"))


def _fills(spark, d):
    return views.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("qty"),
    )


@query(
    "p16_slippage",
    f"""WITH {FILLS}, b AS (SELECT *, CASE WHEN l_partkey % 40 <= 0 THEN 50 ELSE 2 + 48 * least(qty / (l_partkey % 40), 1) END AS bps FROM fills)
    SELECT l_orderkey, l_linenumber, l_partkey, round(bps, 6) AS bps, price * (1 + CASE WHEN side = 'buy' THEN 1 ELSE -1 END * bps / 10000) AS price FROM b""",
)
def slippage(spark, d):
    f = _fills(spark, d).withColumn("bps", P.slippage_bps(F.col("qty"), (F.col("l_partkey") % 40).cast("double"), 2.0, 50.0))
    return f.select("l_orderkey", "l_linenumber", "l_partkey", F.round("bps", 6).alias("bps"), P.adverse_price(F.col("price"), F.col("side"), F.col("bps")).alias("price"))


@query("p19_vol_target", f"WITH {PANEL}, {RET}, {VOL} SELECT date, symbol, round(CASE WHEN vol > 0 THEN least(0.5 / vol, 2) ELSE 2 END, 6) AS scale FROM v")
def vol_target(spark, d):
    return _with_vol(spark, d).select("date", "symbol", *r6(scale=P.vol_target(F.col("vol"), 0.5, 2.0)))


HELD = f"""WITH RECURSIVE {PANEL}, t AS (SELECT date, symbol, round(coalesce(volume, 0) / 500.0, 4) AS weight, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM panel),
    f AS (SELECT symbol, i, CASE WHEN abs(weight) > 0.03 THEN weight ELSE 0 END AS held FROM t WHERE i = 1
      UNION ALL SELECT t.symbol, t.i, CASE WHEN abs(t.weight - held) > 0.03 THEN t.weight ELSE held END FROM f JOIN t ON t.symbol = f.symbol AND t.i = f.i + 1)
    SELECT date, symbol, round(held, 4) AS held FROM t JOIN f USING (symbol, i)"""


@query("r05_held_weights", HELD)
def held(spark, d):
    """Holdings of every symbol of the panel."""
    p = views.panel(spark, d).select("date", "symbol", F.round(F.col("volume") / 500.0, 4).alias("weight"))
    return held_weights(p, 0.3, 0.1).select("date", "symbol", F.round("held", 4).alias("held"))


@query(
    "r06_monthly_backtest",
    f"""WITH {PANEL}, {RET}, {VOL}, {BOOK}, e AS (SELECT max(date) AS date FROM panel GROUP BY date_trunc('month', date)),
    m AS (SELECT date, symbol, w, close FROM book SEMI JOIN e USING (date)),
    g AS (SELECT d.date, s.symbol, coalesce(w, 0) AS w, close FROM (SELECT DISTINCT date FROM m) d CROSS JOIN (SELECT DISTINCT symbol FROM m) s LEFT JOIN m USING (date, symbol)),
    y AS (SELECT *, w - coalesce(lag(w) OVER q, 0) AS dw, coalesce(lead(close) OVER q / close - 1, 0) AS r FROM g WINDOW q AS (PARTITION BY symbol ORDER BY date))
    SELECT date, round(sum(abs(dw)), 6) AS turnover, round(sum(w * r), 6) AS gross, round(sum(w * r) - 0.0022 * sum(abs(dw)), 6) AS net FROM y GROUP BY date""",
)
def monthly_backtest(spark, d):
    from ..operators.backtest import rebalanced

    book = _with_vol(spark, d).withColumn("weight", P.inverse_vol())
    at = book.join(C.month_ends(views.panel(spark, d)), "date", "left_semi")
    return rebalanced(at, 0.0022).select("date", *r6(turnover=F.col("turnover"), gross=F.col("gross"), net=F.col("net")))
