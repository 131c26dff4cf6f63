"""Queries of forms that others leave out: deep books, parsed ticks, screens, book volatility, assembled panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rolling
from ..operators import bars as B
from ..operators import cross_section as C
from ..operators import hygiene as H
from ..operators import microstructure as X
from ..operators import models as M
from ..operators import portfolio as P
from ..operators import simulation as S
from ..operators import validation as V
from ..sources import archive, views
from ..streaming.bars import parse_ticks
from .catalog import BARS, PANEL, query
from .features import r6
from .labels import HELD, _held
from .research import ACTIVE, _active
from .simulations import GRID, _grid

# --- books of several levels: three a side, but two where the event's number is a multiple of four

BOOK = """book AS (SELECT event_type AS symbol, ts, event_id, {levels} FROM events)""".format(
    levels=", ".join(
        f"CASE WHEN {i} < 2 OR event_id % 4 <> 0 THEN round(value, 2) - {i} * 0.5 END AS b{i}, CASE WHEN {i} < 2 OR event_id % 4 <> 0 THEN 1 + (event_id + {i}) % 7 ELSE 0 END AS bq{i}, "
        f"CASE WHEN {i} < 2 OR event_id % 4 <> 0 THEN round(value, 2) + 0.5 + {i} * 0.5 END AS a{i}, CASE WHEN {i} < 2 OR event_id % 4 <> 0 THEN 1 + (event_id + {i}) % 5 ELSE 0 END AS aq{i}"
        for i in range(3)
    )
)


def _book(spark, d):
    price, n = F.round("value", 2), F.when(F.col("event_id") % 4 == 0, 2).otherwise(3)

    def side(step, m):
        level = lambda i: F.struct((price + step(i)).alias("price"), (1 + (F.col("event_id") + i) % m).cast("long").alias("quantity"), F.lit(1).cast("long").alias("orders"))
        return F.slice(F.array(*(level(i) for i in range(3))), F.lit(1), n)

    e = views.table(spark, d, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", "event_id", side(lambda i: -i * 0.5, 7).alias("bids"), side(lambda i: 0.5 + i * 0.5, 5).alias("asks"))


@query("s25_deep_books", f"WITH {BOOK} SELECT event_id, b0 AS bid_price_1, round(b2, 2) AS bid_price_3, round(a2, 2) AS ask_price_3, bq2::BIGINT AS bid_qty_3, aq1::BIGINT AS ask_qty_2, CAST(NULL AS DOUBLE) AS ask_price_5, CAST(0 AS BIGINT) AS ask_qty_5 FROM book")
def deep_books(spark, d):
    return X.flattened(_book(spark, d), 5).select("event_id", "bid_price_1", F.round("bid_price_3", 2).alias("bid_price_3"), F.round("ask_price_3", 2).alias("ask_price_3"), "bid_qty_3", "ask_qty_2", "ask_price_5", F.col("ask_qty_5").cast("long").alias("ask_qty_5"))


LAGGED = ", ".join(f"lag({c}{i}) OVER w AS p_{c}{i}" for i in range(3) for c in ("b", "bq", "a", "aq"))
FLOW = " + ".join(f"(CASE WHEN b{i} >= p_b{i} THEN bq{i} ELSE 0 END) - (CASE WHEN b{i} <= p_b{i} THEN p_bq{i} ELSE 0 END) - (CASE WHEN a{i} <= p_a{i} THEN aq{i} ELSE 0 END) + (CASE WHEN a{i} >= p_a{i} THEN p_aq{i} ELSE 0 END)" for i in range(3))


@query("w19_deep_flow_imbalance", f"WITH {BOOK}, l AS (SELECT *, {LAGGED}, row_number() OVER w AS n FROM book WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)) SELECT event_id, CASE WHEN n > 1 THEN ({FLOW})::BIGINT END AS ofi FROM l")
def deep_flow_imbalance(spark, d):
    return X.order_flow_imbalance(_book(spark, d), 3).select("event_id", F.col("ofi").cast("long").alias("ofi"))


@query("w20_deep_imbalance", f"WITH {BOOK} SELECT event_id, round((bq0 + bq1 + bq2 - aq0 - aq1 - aq2)::DOUBLE / (bq0 + bq1 + bq2 + aq0 + aq1 + aq2), 6) AS imbalance, round((a0 - b0) / ((a0 + b0) / 2) * 10000, 4) AS spread_bps FROM book")
def deep_imbalance(spark, d):
    return X.spreads(_book(spark, d), 3).select("event_id", F.round("imbalance", 6).alias("imbalance"), F.round("spread_bps", 4).alias("spread_bps"))


@query("s24_depth_archive", f"WITH {BOOK}, h AS (SELECT *, date_trunc('hour', ts) AS hour FROM book) SELECT symbol, hour, arg_max(event_id, row(ts, event_id)) AS event_id, arg_max(b0, row(ts, event_id)) AS bid FROM h GROUP BY symbol, hour")
def depth_archive(spark, d):
    """Snapshots of an hour count as one: the last stays."""
    b = _book(spark, d).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    kept = archive.keep_last(b, ("symbol", "hour"), ("ts", "event_id"))
    return X.flattened(kept, 1).select("symbol", "hour", "event_id", F.col("bid_price_1").alias("bid"))


# --- ticks, screens, sides

@query(
    "p20_parsed_ticks",
    """SELECT event_type AS symbol, value AS last_price, event_id AS last_quantity, CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 1 SECOND ELSE ts END AS ts, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END::INT AS bids, 0 AS asks FROM events WHERE event_type <> 'error'""",
)
def parsed_ticks(spark, d):
    """Events as JSON ticks, some without a time of their own, some without depth; instruments know all kinds but one."""
    code = F.length("event_type") * 1000 + F.ascii("event_type")
    e = views.table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    tick = F.struct(
        code.alias("instrument"), F.col("value").alias("last_price"), F.col("event_id").alias("last_quantity"), F.when(F.col("event_id") % 3 != 0, F.col("t")).alias("ts"),
        (F.col("t") - F.expr("interval 1 second")).alias("last_trade_time"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.col("value").alias("price"), F.lit(1).alias("quantity"), F.lit(1).alias("orders")))).alias("bids"),
    )
    raw = e.select(F.to_json(tick, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))
    names = e.where("event_type <> 'error'").select(code.cast("long").alias("instrument"), F.col("event_type").alias("symbol")).distinct()
    known, _ = parse_ticks(raw, names)
    return known.select("symbol", "last_price", "last_quantity", F.col("ts").cast("timestamp_ntz").alias("ts"), F.size("bids").alias("bids"), F.size("asks").alias("asks"))


@query(
    "p02_screen_by_spread",
    f"""WITH {BARS}, a AS (SELECT symbol, CAST(ts AS DATE) AS day, sum(close * volume) AS v FROM bars GROUP BY ALL), s AS (SELECT symbol, avg(v) AS adv FROM a GROUP BY symbol), w AS (SELECT symbol, avg((high - low) / close) AS spread FROM bars GROUP BY symbol)
    SELECT symbol, concat_ws(',', CASE WHEN adv < 150000 THEN 'low_value' END, CASE WHEN spread > 7 THEN 'wide_spread' END, CASE WHEN symbol = 'view' THEN 'excluded' END) AS reasons FROM s JOIN w USING (symbol)""",
)
def screen_by_spread(spark, d):
    b = views.bars(spark, d)
    wide = b.groupBy("symbol").agg(F.avg((F.col("high") - F.col("low")) / F.col("close")).alias("spread"))
    return H.screened(H.average_daily_value(b).join(wide, "symbol"), 150_000, 7, ["view"]).select("symbol", F.array_join("reasons", ",").alias("reasons"))


@query(
    "p08_liquidity_gate",
    f"""WITH {PANEL}, k AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 60), s AS (SELECT symbol, quantile_cont(value, 0.5) AS median, avg((volume > 20)::INT) AS continuity FROM k GROUP BY symbol)
    SELECT symbol, concat_ws(',', CASE WHEN NOT median >= 30000 THEN 'value' END, CASE WHEN NOT continuity >= 0.6 THEN 'continuity' END) AS failed, median >= 30000 AND continuity >= 0.6 AS passes FROM s""",
)
def liquidity_gate(spark, d):
    k = archive.newest(views.panel(spark, d), 60, "symbol", "date").groupBy("symbol")
    s = k.agg(F.percentile("value", F.lit(0.5)).alias("median"), F.avg((F.col("volume") > 20).cast("int")).alias("continuity"))
    return V.gate(s, {"value": F.col("median") >= 30_000, "continuity": F.col("continuity") >= 0.6}).select("symbol", "failed", "passes")


@query("w39_mean_reversion_side", f"WITH {BARS} SELECT symbol, ts, -CAST(coalesce(sign(close - lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts)), 0) AS INT) AS side FROM bars")
def mean_reversion_side(spark, d):
    return views.bars(spark, d).select("symbol", "ts", (-B.side_by_momentum(5)).alias("side"))


@query("j02_reindexed", f"WITH {PANEL}, e AS (SELECT max(date) AS date FROM panel GROUP BY date_trunc('month', date)) SELECT e.date, s.symbol, p.close FROM e CROSS JOIN (SELECT DISTINCT symbol FROM panel) s LEFT JOIN panel p ON p.date = e.date AND p.symbol = s.symbol")
def reindexed(spark, d):
    """Closes at every month's last date, missing where a name has none."""
    p = views.panel(spark, d)
    ends = C.month_ends(p).agg(F.sort_array(F.collect_set("date")).alias("days"))  # one row
    grid = p.select("symbol").distinct().join(F.broadcast(ends)).select("symbol", F.explode("days").alias("date"))
    return grid.join(p.select("date", "symbol", "close"), ["date", "symbol"], "left").select("date", "symbol", "close")


@query(
    "j04_outer_factors",
    f"""WITH {PANEL}, a AS (SELECT date, symbol, close AS x FROM panel WHERE volume > 60), b AS (SELECT date, symbol, ln(value) AS x FROM panel WHERE close < 1600 AND value > 0)
    SELECT date, symbol, round((coalesce(a.x, 0) * 2 + coalesce(b.x, 0)) / (CASE WHEN a.x IS NULL THEN 0 ELSE 2 END + CASE WHEN b.x IS NULL THEN 0 ELSE 1 END) + 1e-9, 6) AS score FROM a FULL JOIN b USING (date, symbol)""",
)
def outer_factors(spark, d):
    """Two factors that know different names: a name is scored by those it has."""
    p = views.panel(spark, d)
    a = p.where("volume > 60").select("date", "symbol", F.col("close").alias("a"))
    b = p.where("close < 1600 and value > 0").select("date", "symbol", F.ln("value").alias("b"))
    return a.join(b, ["date", "symbol"], "full").select("date", "symbol", *r6(score=C.composite({"a": 2.0, "b": 1.0}) + 1e-9))


# --- books and stats

@query("r08_event_driven", f"WITH {HELD}, m AS (SELECT *, held - coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY ts), 0) AS dl FROM h) SELECT symbol, ts, held::INT AS held, (dl <> 0)::INT AS filled FROM m")
def event_driven(spark, d):
    """Fills of the bar-by-bar engine; its cash and equity are compared with the window form in r10_engine_report."""
    return S.equity_by_loop(_held(spark, d), 100_000.0).select("symbol", "ts", F.col("held").cast("int").alias("held"), "filled")


@query(
    "r12_synthetic_cash",
    f"WITH {PANEL}, n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day FROM (SELECT DISTINCT date FROM panel)) SELECT date, round(pow(pow(1.06, 1.0 / 252), day), 6) AS price FROM n",
)
def synthetic_cash(spark, d):
    from ..functions.columns import numbered

    days = numbered(views.panel(spark, d).select("date").distinct(), ["date"], "day")
    return days.select("date", *r6(price=S.cash_price(F.col("day"), 0.06)))


@query(
    "r15_book_volatility",
    f"""WITH {PANEL}, {GRID}, r AS (SELECT *, price / lag(price) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM g),
    v AS (SELECT *, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END * sqrt(252) AS vol FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    b AS (SELECT date, symbol, i, (1 / vol) / sum(1 / vol) OVER (PARTITION BY date) AS w FROM v WHERE vol > 0 AND date IN (SELECT date FROM ends)),
    p AS (SELECT b.date, r.date AS at, sum(w * ret) AS ret FROM b JOIN r ON r.symbol = b.symbol AND r.i > b.i - 20 AND r.i <= b.i GROUP BY ALL), k AS (SELECT date, stddev_samp(ret) * sqrt(252) AS vol FROM p GROUP BY date),
    sc AS (SELECT date, symbol, w * CASE WHEN vol > 0 THEN least(1, 8 / vol) ELSE 1 END AS w FROM b JOIN k USING (date))
    SELECT date, symbol, round(w, 6) AS weight FROM sc UNION ALL SELECT date, 'cash', round(1 - sum(w), 6) FROM sc GROUP BY date""",
)
def book_volatility(spark, d):
    """Inverse-volatility weights scaled by the volatility that the book itself had over the 20 dates before."""
    g = _grid(spark, d).withColumn("ret", F.try_divide("price", F.lag("price").over(C.dated())) - 1)
    g = g.withColumn("vol", rolling(F.stddev_samp("ret"), "ret", 20, C.dated()) * F.sqrt(F.lit(252.0)))
    book = g.where("vol > 0").join(C.month_ends(g), "date", "left_semi").select("date", "symbol", P.inverse_vol().alias("weight"))
    return P.scaled_by_book(book, g.select("date", "symbol", "ret"), 20, 8.0, "cash").select("date", "symbol", *r6(weight=F.col("weight") + 0.0))


@query("a17_combined_statistic", f"WITH {ACTIVE} SELECT count(*) AS n, round(avg(net) / (stddev_pop(net) * sqrt(3.0 * count(*) / (3 * count(*) - 1))) * sqrt(count(*)), 6) AS t, round(avg((net < 0)::INT), 6) AS negative FROM a")
def combined_statistic(spark, d):
    """The t statistic of three paths of the same rows end to end, with their overlap taken out again."""
    paths = V.combinatorial_results(_active(spark, d), 4, 2, ["date"])
    out = V.deduplicated(paths, "net")
    return out.select((F.col("n") / F.col("paths")).cast("long").alias("n"), *r6(t=F.col("t"), negative=F.col("negative")))


# --- assembly

@query(
    "s28_assembled_panel",
    """WITH s AS (SELECT o_custkey AS isin, o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey AS k, o_totalprice AS close FROM orders UNION SELECT o_custkey, o_orderpriority, o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'),
    l AS (SELECT isin, arg_max(symbol, row(ts, k)) AS symbol FROM s GROUP BY isin) SELECT s.ts::DATE AS date, l.symbol, arg_max(close, row(ts, k)) AS close FROM s JOIN l USING (isin) GROUP BY ALL""",
)
def assembled_panel(spark, d):
    """Shards that overlap, united; an identifier's rows go under its latest name."""
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("isin"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("close"), "o_orderstatus")
    shards = o.unionByName(o.where("o_orderstatus = 'F'")).drop("o_orderstatus").distinct()
    return archive.assembled(shards, "isin", ("ts", "k"))


@query(
    "s29_action_list",
    """WITH a AS (SELECT p_brand AS symbol, DATE '2021-01-04' + (p_size * 13)::INT AS ex_date, CASE WHEN lower(p_type) LIKE '%economy%' THEN 'split' WHEN lower(p_type) LIKE '%small%' THEN 'bonus' WHEN lower(p_type) LIKE '%promo%' THEN 'dividend' END AS kind FROM part)
    SELECT DISTINCT symbol, ex_date, kind, date_trunc('quarter', ex_date)::DATE AS quarter FROM a WHERE kind IS NOT NULL""",
)
def action_list(spark, d):
    """Subjects classified by what they mention, dates parsed, repeats dropped, windows by quarter."""
    shown = F.date_format(F.date_add(F.lit("2021-01-04").cast("date"), F.col("p_size") * 13), "dd-MMM-yyyy")
    raw = views.table(spark, d, "part").select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("subject"), shown.alias("ex"))
    return H.action_list(raw, {"split": "economy", "bonus": "small", "dividend": "promo"})


@query("m10_selection_score")
def selection_score(spark, d):
    """Tested against a loop over the clusters that the library found."""
    e = views.table(spark, d, "embeddings")
    return M.selection_score(M.kmeans(e, 5), "embedding", "vec_id")
