"""Queries of books with costs in the equity, rotations, and checks of one engine by another."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rolling, rolling_quantile
from ..operators import backtest
from ..operators import cross_section as C
from ..operators import portfolio as P
from ..operators import simulation as S
from ..sources import views
from .catalog import BARS, PANEL, gated, query
from .cross import BOOK, RET, VOL, _with_vol
from .features import r6
from .labels import HELD, _held

#: Sector indices on a filled grid, with made-up spreads and taxes for each.
GRID = """s AS (SELECT date, sector AS symbol, sum(value) / sum(volume) AS p FROM panel GROUP BY ALL),
    g0 AS (SELECT date, symbol, last_value(p IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS price FROM (SELECT DISTINCT date FROM s) CROSS JOIN (SELECT DISTINCT symbol FROM s) LEFT JOIN s USING (date, symbol)),
    g AS (SELECT * FROM g0 WHERE date >= (SELECT max(d) FROM (SELECT min(date) AS d FROM g0 WHERE price IS NOT NULL GROUP BY symbol))),
    ends AS (SELECT max(date) AS date FROM g GROUP BY date_trunc('month', date))"""
SIMULATED = """v AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, lag(price) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM legs),
    sim AS (SELECT 0 AS i, symbol, 0.0::DOUBLE AS leg, 100000.0::DOUBLE AS equity, false AS begun FROM v WHERE i = 1
      UNION ALL SELECT i, symbol, CASE WHEN reb THEN t * (coalesce(tot, equity) - cost) / nullif(sum(t) OVER (), 0) ELSE d END, coalesce(tot, equity) - cost, begun OR reb
      FROM (SELECT *, sum(CASE WHEN reb AND abs(t - d) >= 1e-9 THEN abs(t - d) * spread / 2 / 1e4 + abs(t - d) * (0.0000325 + 0.000001) * 1.18
                 + CASE WHEN t > d THEN abs(t - d) * 0.00015 ELSE abs(t - d) * tax / 1e4 + 15.93 END ELSE 0 END) OVER () AS cost
        FROM (SELECT *, w * coalesce(tot, equity) AS t FROM (SELECT v.i, v.symbol, sim.equity, begun, spread, tax, coalesce(w, 0) AS w, count(w) OVER () > 0 AS reb,
              CASE WHEN leg = 0 THEN 0 ELSE leg * price / prev END AS d, nullif(sum(CASE WHEN leg = 0 THEN 0 ELSE leg * price / prev END) OVER (), 0) AS tot
              FROM sim JOIN v ON v.i = sim.i + 1 AND v.symbol = sim.symbol))))"""


def _grid(spark, d):
    p = views.panel(spark, d).groupBy("date", F.col("sector").alias("symbol")).agg(F.try_divide(F.sum("value"), F.sum("volume")).alias("price"))
    return S.filled_grid(p)


def _charges(df):
    code = F.ascii(F.right("symbol", F.lit(1)))
    return df.withColumns({"book": F.lit("one"), "spread_bps": (5 + code % 5).cast("double"), "tax_bps": F.when(code % 2 == 0, 0.1).otherwise(0.0)})


CHARGES = "(5 + ascii(right(symbol, 1)) % 5)::DOUBLE AS spread, CASE WHEN ascii(right(symbol, 1)) % 2 = 0 THEN 0.1 ELSE 0 END AS tax"


@query(
    "r11_equal_weight",
    f"""WITH RECURSIVE {PANEL}, {GRID}, legs AS (SELECT date, symbol, price, CASE WHEN date IN (SELECT date FROM ends) OR date = (SELECT min(date) FROM g) THEN 1.0 / count(*) OVER (PARTITION BY date) END AS w, {CHARGES} FROM g),
    {SIMULATED} SELECT v.date, round(ln(any_value(equity) / 100000), 6) AS growth FROM sim JOIN v USING (i, symbol) GROUP BY v.date""",
)
def equal_weight(spark, d):
    """Sector indices, rebalanced to equal weights at the first date and at month ends."""
    g = _grid(spark, d)
    ends = C.month_ends(g).union(g.agg(F.min("date").alias("date"))).distinct().withColumn("reb", F.lit(True))
    legs = g.join(ends, "date", "left").withColumn("weight", F.when(F.col("reb"), 1 / F.count("*").over(C.on_date())))
    return S.simulated(_charges(legs), 100_000.0).select("date", F.round(F.ln(F.col("equity") / 100_000.0), 6).alias("growth"))


ROTATION = f"""{GRID}, x AS (SELECT *, price / lag(price) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret, price / lag(price, 20) OVER (PARTITION BY symbol ORDER BY date) - 1 AS score FROM g),
    y AS (SELECT *, {gated('stddev_samp(ret)', 'ret', 20, order='date')} * sqrt(252) AS vol FROM x),
    m AS (SELECT date, vol * 1.000000001 >= quantile_cont(vol, 2.0 / 3) OVER (ORDER BY date ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS off, row_number() OVER (ORDER BY date) AS n FROM y WHERE symbol = (SELECT min(symbol) FROM g)),
    z AS (SELECT y.*, coalesce(off AND n > 252, false) AS off, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY y.date ORDER BY score DESC NULLS LAST, symbol) END AS place FROM y JOIN m USING (date) WHERE y.date IN (SELECT date FROM ends)),
    k AS (SELECT *, CASE WHEN place <= 2 THEN 1 / greatest(coalesce(vol, 0), 1e-6) END AS inv FROM z),
    w AS (SELECT date, symbol, coalesce((1 - CASE WHEN off THEN 0.5 ELSE 0 END) * inv / sum(inv) OVER (PARTITION BY date), 0) AS w FROM k)"""


def _rotation(spark, d):
    g = _grid(spark, d)
    y = g.withColumns({"close": F.col("price"), "ret": F.try_divide("price", F.lag("price").over(C.dated())) - 1, "score": F.try_divide("price", F.lag("price", 20).over(C.dated())) - 1})
    y = y.withColumn("vol", rolling(F.stddev_samp("ret"), "ret", 20, C.dated()) * F.sqrt(F.lit(252.0)))
    first = g.agg(F.min("symbol").alias("symbol"))
    market = y.join(F.broadcast(first), "symbol", "left_semi")
    off = (F.col("vol") * 1.000000001 >= rolling_quantile("vol", 2.0 / 3, 61, C.dated(), 1)) & (F.row_number().over(C.dated()) > 252)
    m = market.select("date", F.coalesce(off, F.lit(False)).alias("risk_off"))
    ranked = y.join(C.month_ends(g), "date", "left_semi").join(m, "date")
    return g, S.rotation_weights(ranked, 2, 0.5, "cash")


@query("k03_rotation_weights", f"WITH {PANEL}, {ROTATION} SELECT date, symbol, round(w, 6) AS weight FROM w UNION ALL SELECT date, 'cash', round(1 - sum(w), 6) FROM w GROUP BY date")
def rotation_weights(spark, d):
    return _rotation(spark, d)[1].select("date", "symbol", *r6(weight=F.col("weight") + 0.0))


@query(
    "r13_rotation_backtest",
    f"""WITH RECURSIVE {PANEL}, {ROTATION}, c AS (SELECT date, 'cash' AS symbol, pow(pow(1.06, 1.0 / 252), row_number() OVER (ORDER BY date) - 1) AS price FROM (SELECT DISTINCT date FROM g)),
    ww AS (SELECT * FROM w UNION ALL SELECT date, 'cash', 1 - sum(w) FROM w GROUP BY date),
    legs AS (SELECT date, symbol, price, w, {CHARGES} FROM (SELECT date, symbol, price FROM g UNION ALL SELECT * FROM c) LEFT JOIN ww USING (date, symbol)),
    {SIMULATED} SELECT v.date, round(ln(any_value(CASE WHEN begun THEN equity ELSE 100000 END) / 100000), 6) AS growth FROM sim JOIN v USING (i, symbol) GROUP BY v.date""",
)
def rotation_backtest(spark, d):
    """The rotation's schedule with a cash leg of its own price."""
    from pyspark.sql import Window

    g, weights = _rotation(spark, d)
    days = g.select("date").distinct().withColumn("day", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)  # the calendar
    cash = days.select("date", F.lit("cash").alias("symbol"), S.cash_price(F.col("day"), 0.06).alias("price"))
    legs = g.unionByName(cash).join(weights, ["date", "symbol"], "left")
    return S.simulated(_charges(legs), 100_000.0).select("date", F.round(F.ln(F.col("equity") / 100_000.0), 6).alias("growth"))


def _month_book(spark, d):
    p = _with_vol(spark, d).withColumn("weight", P.inverse_vol())
    return p.join(C.month_ends(views.panel(spark, d)), "date", "left_semi")


BANDED = f"""{PANEL}, {RET}, {VOL}, {BOOK}, e AS (SELECT max(date) AS date FROM panel GROUP BY date_trunc('month', date)),
    m AS (SELECT date, symbol, w, close FROM book SEMI JOIN e USING (date)),
    g AS (SELECT d.date, s.symbol, coalesce(w, 0) AS w, close, row_number() OVER (PARTITION BY s.symbol ORDER BY d.date) AS i FROM (SELECT DISTINCT date FROM m) d CROSS JOIN (SELECT DISTINCT symbol FROM m) s LEFT JOIN m USING (date, symbol)),
    f AS (SELECT symbol, i, w AS held FROM g WHERE i = 1
      UNION ALL SELECT g.symbol, g.i, CASE WHEN abs(w - held) > 0.25 * greatest(abs(w), abs(held)) THEN w ELSE held END FROM f JOIN g ON g.symbol = f.symbol AND g.i = f.i + 1),
    h AS (SELECT date, symbol, held, held - coalesce(lag(held) OVER q, 0) AS dw, coalesce(lead(close) OVER q / close - 1, 0) AS r FROM g JOIN f USING (symbol, i) WINDOW q AS (PARTITION BY symbol ORDER BY date))"""


@query("r05_banded_holdings", f"WITH RECURSIVE {BANDED} SELECT date, symbol, round(held, 6) AS held FROM h")
def banded_holdings(spark, d):
    return S.banded_book(_month_book(spark, d), 0.25).select("date", "symbol", *r6(held=F.col("held")))


RATE = S.delivery_rates()["round_trip"]


@query(
    "r06_banded_backtest",
    f"""WITH RECURSIVE {BANDED} SELECT date, round(sum(abs(dw)), 6) AS turnover, round(sum(abs(dw)) * 0.00225316, 6) AS cost, round(sum(held * r), 6) AS gross, round(sum(held * r) - sum(abs(dw)) * 0.00225316, 6) AS net FROM h GROUP BY date""".replace("0.00225316", repr(RATE)),
)
def banded_backtest(spark, d):
    out = S.book_returns(S.banded_book(_month_book(spark, d), 0.25), RATE)
    return out.select("date", *r6(turnover=F.col("turnover"), cost=F.col("cost"), gross=F.col("gross"), net=F.col("net")))


@query("r07_two_engines", f"WITH {PANEL} SELECT count(DISTINCT date_trunc('month', date)) AS rows, true AS agree FROM panel")
def two_engines(spark, d):
    """The window form and the loop give the same net returns."""
    held = S.banded_book(_month_book(spark, d), 0.25)
    out = S.disagreement(S.book_returns(held, RATE).select("date", "net"), S.book_returns_by_loop(held, RATE), ["date"], ["net"])
    return out.select("rows", (F.col("net") < 1e-12).alias("agree"))


@query(
    "r10_engine_report",
    f"""WITH {HELD}, m AS (SELECT symbol, held <> coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY ts), 0) AS f FROM h)
    SELECT symbol, count(*) AS bars, count(*) FILTER (f) AS fills, count(*) FILTER (f) AS other_fills, true AS reconciled FROM m GROUP BY symbol""",
)
def engine_report(spark, d):
    """Bar by bar and window forms of one strategy: fills of both, and whether cash and equity agree within a paisa."""
    held = _held(spark, d)
    a = backtest.equity(held, 100_000.0).select("symbol", "ts", (F.col("delta") != 0).cast("int").alias("f"), "cash", "equity")
    b = S.equity_by_loop(held, 100_000.0).select("symbol", "ts", F.col("filled"), F.col("cash").alias("c"), F.col("equity").alias("e"))
    both = a.join(b, ["symbol", "ts"], "full").groupBy("symbol")
    gap = F.coalesce(F.max(F.greatest(F.abs(F.col("cash") - F.col("c")), F.abs(F.col("equity") - F.col("e")))), F.lit(0.0))
    return both.agg(F.count("*").alias("bars"), F.sum("f").alias("fills"), F.sum("filled").alias("other_fills"), gap.alias("gap")).select(
        "symbol", "bars", "fills", "other_fills", ((F.col("fills") == F.col("other_fills")) & (F.col("gap") <= 0.01)).alias("reconciled")
    )


@query(
    "p14_delivery_costs",
    """SELECT p_partkey, round(p_retailprice * (0.001 + 0.00003 + 0.000001 + 0.18 * (0.00003 + 0.000001) + 0.00015), 8) AS buy, round(p_retailprice * (0.001 + 0.00003 + 0.000001 + 0.18 * (0.00003 + 0.000001)), 8) AS sell,
    round(p_retailprice * (2 * (0.001 + 0.00003 + 0.000001 + 0.18 * (0.00003 + 0.000001)) + 0.00015), 8) AS round_trip FROM part""",
)
def delivery_costs(spark, d):
    r = S.delivery_rates()
    return views.table(spark, d, "part").select("p_partkey", *(F.round(F.col("p_retailprice") * r[k], 8).alias(k) for k in ("buy", "sell", "round_trip")))


@query(
    "p15_fund_round_trip",
    """WITH v AS (SELECT p_partkey, p_retailprice AS v, (p_size % 9)::DOUBLE AS s, CASE WHEN p_size % 2 = 0 THEN 0.1 ELSE 0 END AS tax, p_size FROM part)
    SELECT p_partkey, round((2 * (v * s / 2 / 1e4 + 1.18 * v * 0.0000335) + v * 0.00015 + v * tax / 1e4 + 15.93) / v * 1e4 + 1e-9, 6) AS round_trip, round(0.0005 * p_size / 365.0 * 1e4, 6) AS holding FROM v""",
)
def fund_round_trip(spark, d):
    p = views.table(spark, d, "part")
    tax = F.when(F.col("p_size") % 2 == 0, 0.1).otherwise(0.0)
    return p.select("p_partkey", *r6(round_trip=S.round_trip_bps(F.col("p_retailprice"), (F.col("p_size") % 9).cast("double"), tax) + 1e-9, holding=S.holding_bps(F.lit(0.0005), F.col("p_size"))))


@query(
    "p17_round_trip_share",
    f"""WITH {BARS}, m AS (SELECT symbol, quantile_cont(close, 0.5) AS p, quantile_cont(volume, 0.5) AS l FROM bars GROUP BY symbol), q AS (SELECT *, greatest(1, floor(100000 / p)) AS n FROM m),
    b AS (SELECT *, p * n AS t, least(p * n * 0.0003, 20) AS b, CASE WHEN l <= 0 THEN 50 ELSE 2 + 48 * least(n / l, 1) END AS bps FROM q)
    SELECT symbol, round((2 * (b + t * 0.0000297 + t * 0.000001 + (b + t * 0.0000297 + t * 0.000001) * 0.18) + t * 0.00003 + t * 0.00025) / t + 2 * bps / 10000, 8) AS share FROM b""",
)
def round_trip_share(spark, d):
    """A representative order of each symbol: 100,000 at the median price against the median volume."""
    m = views.bars(spark, d).groupBy("symbol").agg(F.percentile("close", F.lit(0.5)).alias("p"), F.percentile("volume", F.lit(0.5)).alias("l"))
    n = F.greatest(F.lit(1.0), F.floor(100_000 / F.col("p")).cast("double"))
    return m.select("symbol", F.round(S.round_trip_share(F.col("p"), n, P.slippage_bps(n, F.col("l"), 2.0, 50.0)), 8).alias("share"))
