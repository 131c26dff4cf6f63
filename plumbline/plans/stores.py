"""Queries that write stores below the shared folder and read them back, of streams that count, and of guards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.normal import normal_inverse_sql
from ..operators import cross_section as C
from ..operators import joins
from ..operators import microstructure as X
from ..operators import validation as V
from ..sources import archive, views
from ..sources.shared import new_path
from ..streaming import counts as K
from ..streaming.bars import hot_window, run_once
from ..streaming.sinks import MergedStore, depth_store, reaction_store
from .catalog import BARS, PANEL, query
from .cross import RET, rank_sql
from .details import BOOK, _book
from .features import r6
from .streams import _checkpoint

HALF = "2024-01-15"


@query("s01_archive_round_trip", f"WITH {BARS} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def archive_round_trip(spark, d):
    """The first half is archived, then all bars, of which the first half is the same and stays, and reread by symbol."""
    bars = views.bars(spark, d)
    store = archive.ParquetArchive(spark, new_path(spark, "archive"))
    store.write(bars.where(f"ts < timestamp_ntz'{HALF}'"))
    store.write(bars)
    return archive.concat([store.read(s, "2000-01-01", "2100-01-01") for s in store.symbols()], spark)


@query("s02_archive_days", f"WITH {BARS} SELECT symbol, ts, close FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 12:00:00'")
def archive_days(spark, d):
    """A range of the archive, of which whole days are pruned by their folders."""
    store = archive.ParquetArchive(spark, new_path(spark, "archive"))
    store.write(views.bars(spark, d))
    parts = [store.read(s, "2024-01-10", "2024-01-12 12:00:00") for s in store.symbols()]
    return archive.concat(parts, spark).select("symbol", "ts", "close")


def _versions(spark, d):
    """Every symbol: its first half, the same again (no version), and all bars."""
    bars = views.bars(spark, d)
    store = archive.VersionedStore(spark, new_path(spark, "versions"))
    names = [r[0] for r in bars.select("symbol").distinct().orderBy("symbol").collect()]  # a name a symbol
    for s in names:
        for part in (bars.where(f"ts < timestamp_ntz'{HALF}'"), bars.where(f"ts < timestamp_ntz'{HALF}'"), bars):
            store.write(s, part)
    return store, names


@query("s04_versions", f"WITH {BARS} SELECT DISTINCT symbol, unnest([1, 2])::INTEGER AS version, 2::INTEGER AS latest FROM bars")
def versions(spark, d):
    store, names = _versions(spark, d)
    return spark.createDataFrame([(s, v, max(store.versions(s))) for s in names for v in store.versions(s)], "symbol string, version int, latest int")


@query(
    "s05_time_travel",
    f"""WITH {BARS} SELECT symbol, 1::INTEGER AS version, count(*) AS bars, round(sum(close), 4) AS total FROM bars WHERE ts < TIMESTAMP '{HALF}' GROUP BY symbol
    UNION ALL SELECT symbol, 2, count(*), round(sum(close), 4) FROM bars GROUP BY symbol""",
)
def time_travel(spark, d):
    """The first version by number, the second as the latest."""
    store, names = _versions(spark, d)
    out = None
    for s in names:
        for number, asked in ((1, 1), (2, None)):
            one = store.read(s, asked).groupBy("symbol").agg(F.lit(number).alias("version"), F.count("*").alias("bars"), F.round(F.sum("close"), 4).alias("total"))
            out = one if out is None else out.unionByName(one)
    return out


@query(
    "s08_hot_range",
    f"WITH {BARS}, k AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 200) SELECT symbol, ts, close FROM k WHERE ts BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-26'",
)
def hot_range(spark, d):
    """A range of the hot store, which keeps the newest 200 bars of a symbol."""
    bars = views.bars(spark, d)
    kept = archive.merged(bars.where(f"ts < timestamp_ntz'{HALF}'"), bars, 200)
    return archive.between(kept, "2024-01-24", "2024-01-26").select("symbol", "ts", "close")


@query("s09_checked_columns", f"WITH {BARS} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def checked_columns(spark, d):
    """Bars with their columns in another order and volume as a double come out in the bars' order and types."""
    shuffled = views.bars(spark, d).select("volume", "close", "symbol", "low", "high", "open", "ts").withColumn("volume", F.col("volume").cast("double"))
    return archive.ensure_bars(shuffled)


@query("s10_sorted", f"WITH {BARS} SELECT symbol, ts, row_number() OVER (ORDER BY symbol, ts) - 1 AS place FROM bars")
def sorted_bars(spark, d):
    """The place of every bar after sorting: ranges of the sorted rows follow each other."""
    from ..functions.columns import numbered

    return numbered(views.bars(spark, d).select("symbol", "ts").repartition(7), ["symbol", "ts"], "place")


@query(
    "s13_same_rows",
    f"""WITH {BARS}, o AS (SELECT symbol, ts, CASE WHEN ts = (SELECT max(ts) FROM bars) THEN close + 1 ELSE close END AS close FROM bars), a AS (SELECT symbol, ts, close FROM bars),
    t AS (SELECT (SELECT count(*) FROM (FROM a EXCEPT ALL FROM a)) = 0 AS same, (SELECT count(*) FROM (FROM a EXCEPT ALL FROM o)) = 0 AS changed, (SELECT count(*) FROM (SELECT * FROM (FROM a UNION ALL FROM a) EXCEPT ALL FROM a)) = 0 AS doubled)
    SELECT * FROM t""",
)
def same_rows(spark, d):
    """Bars against themselves in another order, with one close changed, and with every bar twice."""
    a = views.bars(spark, d).select("symbol", "ts", "close")
    last = a.agg(F.max("ts").alias("_last"))  # one row
    changed = a.join(F.broadcast(last)).withColumn("close", F.when(F.col("ts") == F.col("_last"), F.col("close") + 1).otherwise(F.col("close"))).drop("_last")
    found = (archive.same_rows(a, a.repartition(5).select("close", "ts", "symbol")), archive.same_rows(a, changed), archive.same_rows(a.union(a), a))
    return spark.createDataFrame([found], "same boolean, changed boolean, doubled boolean")


@query("u01_concat", f"WITH {BARS} SELECT symbol, ts, close, volume FROM bars UNION ALL SELECT symbol, ts, close, volume FROM bars WHERE volume > 100")
def concat(spark, d):
    """Frames whose columns stand in other orders, united by name."""
    bars = views.bars(spark, d)
    busy = bars.where("volume > 100").select("volume", "close", "low", "high", "open", "ts", "symbol")
    return archive.concat([bars, busy], spark).select("symbol", "ts", "close", "volume")


@query("j03_checked_lookup", "SELECT o_orderpriority AS priority, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def checked_lookup(spark, d):
    """Lines by their order's priority; a line without its order would be an error."""
    lines = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    orders = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"))
    return joins.checked_lookup(lines, orders, ["key"]).groupBy("priority").agg(F.count("*").alias("lines"))


@query("j12_checked_sectors", f"WITH {PANEL} SELECT date, symbol, sector FROM panel")
def checked_sectors(spark, d):
    """Every name's sector from a list of its own; a name without one would be an error."""
    panel = views.panel(spark, d)
    listed = panel.select("symbol", "sector").distinct()
    return joins.checked_lookup(panel.select("date", "symbol"), listed, ["symbol"]).select("date", "symbol", "sector")


@query("s22_instrument_tokens", "SELECT o_orderkey AS row, c_custkey AS token FROM orders JOIN customer ON o_custkey = c_custkey")
def instrument_tokens(spark, d):
    """The token of every order's instrument, looked up by segment and name; an unlisted instrument would be an error."""
    c = views.table(spark, d, "customer").select(F.col("c_mktsegment").alias("exchange"), F.col("c_name").alias("symbol"), F.col("c_custkey").alias("token"))
    o = views.table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("token")).select(F.col("o_orderkey").alias("row"), "exchange", "symbol")
    return joins.checked_lookup(o, c, ["exchange", "symbol"]).select("row", "token")


@query(
    "c06_attached",
    f"""WITH {PANEL} SELECT date, symbol, round({rank_sql("close")} - 0.5, 6) AS close_rank, round({rank_sql("volume")} - 0.5, 6) AS volume_rank,
    round((close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0), 6) AS close_z, round((volume - avg(volume) OVER w) / nullif(stddev_samp(volume) OVER w, 0), 6) AS volume_z FROM panel WINDOW w AS (PARTITION BY date, sector)""",
)
def attached(spark, d):
    out = C.attached(views.panel(spark, d), ["close", "volume"])
    return out.select("date", "symbol", *r6(**{c: F.col(c) for c in ("close_rank", "volume_rank", "close_z", "volume_z")}))


BEST = f"sqrt(v) * ({1 - V.EULER}::DOUBLE * ({normal_inverse_sql('1 - 1 / k::DOUBLE')}) + {V.EULER}::DOUBLE * ({normal_inverse_sql('1 - 1 / (k * 2.718281828459045::DOUBLE)')}))"


@query(
    "a15_expected_best",
    f"""WITH {PANEL}, {RET}, s AS (SELECT sector, symbol, avg(ret) / stddev_samp(ret) AS s FROM r GROUP BY ALL), t AS (SELECT sector, count(*) AS k, var_samp(s) AS v FROM s GROUP BY sector)
    SELECT sector, k AS trials, round(CASE WHEN k <= 1 THEN 0 ELSE {BEST} END, 6) AS best FROM t""",
)
def expected_best(spark, d):
    """The ratio to expect of the best of a sector's names, were there nothing in any."""
    s = views.panel(spark, d).withColumn("ret", C.daily_return()).groupBy("sector", "symbol").agg(V.sharpe("ret").alias("s"))
    t = s.groupBy("sector").agg(F.count("*").alias("trials"), F.coalesce(F.var_samp("s"), F.lit(0.0)).alias("v"))
    return t.select("sector", "trials", *r6(best=V.expected_best_sharpe_of(F.col("v"), F.col("trials"))))


# --- streams

def _events(spark, d):
    return spark.readStream.schema(views.table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)


@query(
    "t01_tick_counts",
    """WITH e AS (SELECT user_id, date_trunc('millisecond', ts) AS ts FROM events WHERE user_id % 10 <> 0), m AS (SELECT max(ts) AS top FROM e)
    SELECT 'u' || user_id AS symbol, count(*) AS rows, 0::BIGINT AS late, max(ts) AS last_ts, max(ts) + INTERVAL 6 HOUR < any_value(top) - INTERVAL 1 MINUTE AS silent FROM e, m GROUP BY user_id""",
)
def tick_counts(spark, d):
    """Ticks as JSON of a stream whose list of instruments lacks every tenth user: rows, late rows and silence by symbol. The
    stream is drained into a store that keeps a symbol's last row."""
    e = views.table(spark, d, "events")
    users = e.select(F.col("user_id").alias("instrument"), F.concat(F.lit("u"), "user_id").alias("symbol")).where("instrument % 10 <> 0").distinct()
    raw = _events(spark, d).select(F.to_json(F.struct(F.col("user_id").alias("instrument"), F.col("value").alias("last_price"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"))).alias("value"))
    out = K.watched(K.observed(raw, users, "ticks"), "1 minute", 6 * 3600)
    store = MergedStore(spark, new_path(spark, "counts"), out.schema, ["symbol"], ["rows", "silent"])
    out.writeStream.outputMode("update").foreachBatch(store.write).option("checkpointLocation", _checkpoint(spark)).trigger(availableNow=True).start().awaitTermination()
    return store.read().withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query("t01_drops", "SELECT count(*) AS seen, 0::BIGINT AS malformed, count(*) FILTER (user_id % 10 = 0) AS unknown, 0::BIGINT AS untimed FROM events")
def drops(spark, d):
    """What the same stream drops, as the running query reports it."""
    e = views.table(spark, d, "events")
    users = e.select(F.col("user_id").alias("instrument"), F.col("event_type").alias("symbol")).where("instrument % 10 <> 0").groupBy("instrument").agg(F.first("symbol").alias("symbol"))
    raw = _events(spark, d).select(F.to_json(F.struct(F.col("user_id").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"))).alias("value"))
    q = K.observed(raw, users, "ticks").writeStream.format("noop").option("checkpointLocation", _checkpoint(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    found = K.metrics_of(q, "ticks")
    return spark.createDataFrame([tuple(found[c] for c in K.METRICS)], ", ".join(f"{c} long" for c in K.METRICS))


@query(
    "t05_depth_store",
    f"""WITH {BOOK}, h AS (SELECT *, date_trunc('hour', ts) AS hour FROM book) SELECT symbol, hour AS ts, arg_max(event_id, event_id) AS event_id, arg_max(b0, event_id) AS bid FROM h GROUP BY symbol, hour""",
)
def depth_stored(spark, d):
    """Snapshots of an hour count as one: three batches, the second of them twice, are stored and merged; the last stays."""
    b = _book(spark, d).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    flat = X.flattened(b, 1).select("symbol", "ts", "event_id", F.col("bid_price_1").alias("bid"))
    store = depth_store(spark, new_path(spark, "depth"), flat, ["event_id"])
    n = flat.agg(F.max("event_id")).first()[0] + 1
    part = F.floor(F.col("event_id") * 3 / n)
    for number in (0, 1, 1, 2):
        store.write(flat.where(part == number), number)
    store.compact()
    return store.read()


@query("s27_reaction_store", "SELECT event_type AS symbol, date_trunc('day', ts) AS event_time, arg_max(event_id, event_id) AS event_id, round(arg_max(value, event_id), 6) AS reaction FROM events GROUP BY ALL")
def reactions_stored(spark, d):
    """A day's reactions of a symbol count as one; the second batch holds newer rows, the third repeats the first."""
    e = views.table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("event_time"), "event_id", F.round("value", 6).alias("reaction"))
    store = reaction_store(spark, new_path(spark, "reactions"), e, ["event_id"])
    store.write(e.where("event_id % 2 = 0"), 0)
    store.write(e, 1)
    store.write(e.where("event_id % 2 = 0"), 0)
    return store.read()


@query("t06_hot_windows", f"WITH {BARS}, k AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 50) SELECT symbol, count(*) AS n, max(ts) AS last_ts, arg_max(close, ts) AS last_close FROM k GROUP BY symbol")
def hot_windows(spark, d):
    """The newest 50 bars of each symbol kept in a stream's state."""
    path = new_path(spark, "bars")
    bars = views.bars(spark, d).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close")
    bars.write.parquet(path)
    out = hot_window(spark.readStream.schema(bars.schema).parquet(path), 50)
    return run_once(out, f"hot_{uuid.uuid4().hex}", _checkpoint(spark), "update").withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query("s38_redacted_words", "SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN '***' ELSE user_id::VARCHAR END AS own, CASE WHEN event_type = 'view' THEN '***' ELSE value::VARCHAR END AS other FROM events")
def redacted_words(spark, d):
    """Two maps of a row, keyed by its type, with other words to hide in each."""
    from ..sources import exchange

    e = views.table(spark, d, "events")
    key = F.concat(F.lit("My_"), F.upper("event_type"))
    own = exchange.redacted(F.create_map(key, F.col("user_id").cast("string")), ("click", "error"))
    other = exchange.redacted(F.create_map(key, F.col("value").cast("string")), ("view",))
    return e.select("event_id", F.map_values(own)[0].alias("own"), F.map_values(other)[0].alias("other"))
