"""From bars to judged strategies: feature matrix with stationary levels, events, direct and meta labels, pooled rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import numbered, rank_share, rolling, rolling_mean, series
from ..sources.shared import written
from . import bars as B
from . import evaluation as E
from . import folds
from . import labeling as L
from . import unit_roots as U
from . import validation as V
from .cross_section import sector_zscore
from .ensemble import bet_size

#: Columns of prices, which are differenced, and all columns of the matrix.
LEVELS = ("sma_30", "sma_60", "vwma_30", "boll_ub", "boll_lb")
RETURNS, OSCILLATORS = ("ret_1", "ret_3", "ret_5", "ret_10", "rvol_20", "atr_14", "parkinson_20"), ("rsi_30", "macd_hist", "macd_line", "bbands_pb", "cci_30", "dx_30", "mfi_30")
CROSS = ("rank_ret_10", "z_rvol_20")
FEATURES = RETURNS + OSCILLATORS + LEVELS + CROSS
#: Orders of differencing that are tried, where their weights end, the share of rows that the chosen one must keep, the order
#: where none is fit, and the values below which a level stays as it is.
ORDERS, THRESHOLD, KEPT, FALLBACK, SHORT = tuple(i / 10 for i in range(2, 11)), 1e-3, 0.5, 0.5, 128


def stationary_levels(rows: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """symbol, ts and every level differenced by its symbol's least order that passes a unit-root test; by FALLBACK where
    none does or where that leaves less than KEPT of the rows; as it is where it has fewer than SHORT values.

    All levels of all symbols and all orders are tested in the same passes."""
    long = reduce(DataFrame.unionByName, (rows.select(F.col("symbol").alias("_s"), "ts", F.lit(c).alias("_c"), F.col(c).alias("x")) for c in levels)).where("x is not null")
    long = written(long.withColumn("symbol", F.concat_ws("|", "_c", "_s")), "levels")
    sizes = long.groupBy("symbol").agg(F.count("*").alias("n"))
    tried = reduce(DataFrame.unionByName, (long.select("symbol", "_s", "_c", "ts", folds.frac_diff("x", d, THRESHOLD).alias("f"), F.lit(d).alias("d")) for d in ORDERS))
    tried = written(tried, "differences")
    tests = U.augmented_dickey_fuller(tried, "f", ["symbol", "d"], "ts").where("p < 0.05")
    least = tests.groupBy("symbol").agg(F.min(F.struct("d", "values")).alias("m")).select("symbol", "m.d", "m.values")
    fit = F.col("values") >= KEPT * F.col("n")
    chosen = sizes.join(least, "symbol", "left").select("symbol", F.when(F.col("n") < SHORT, None).when(fit, F.col("d")).otherwise(FALLBACK).alias("d"))
    differenced = tried.join(chosen, ["symbol", "d"]).select("_s", "_c", "ts", "f")
    plain = long.join(chosen.where("d is null"), "symbol", "left_semi").select("_s", "_c", "ts", F.col("x").alias("f"))
    both = differenced.unionByName(plain)
    return both.groupBy(F.col("_s").alias("symbol"), "ts").agg(*(F.max(F.when(F.col("_c") == c, F.col("f"))).alias(c) for c in levels))


def feature_matrix(bars: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """symbol, ts, close, FEATURES, vol_regime, trend of every bar (symbol, ts, open, high, low, close, volume).

    groups (symbol, sector) are those of the cross-section's scores; one group of all without them. Nothing looks ahead, but
    for the choice of a level's order, which is made over the whole series, as its purpose is one transform for all rows."""
    b = bars.withColumns({f"ret_{h}": B.log_return("close", h) for h in (1, 3, 5, 10)} | {"parkinson_20": B.parkinson(20)})
    b = b.withColumn("rvol_20", rolling(F.stddev_samp("ret_1"), "ret_1", 20))
    b = B.average_true_range(b, 14).withColumnRenamed("atr", "atr_14")
    low, _, high, place = B.bollinger("close", 20, 2.0)
    b = b.withColumns({"boll_lb": low, "boll_ub": high, "bbands_pb": place, "sma_30": rolling_mean("close", 30), "sma_60": rolling_mean("close", 60), "vwma_30": B.vwma(30)})
    b = B.money_flow(B.commodity_channel(b, 30).withColumnRenamed("cci", "cci_30"), 30).withColumnRenamed("mfi", "mfi_30")
    b = B.volatility_regime(b.drop("rvol") if "rvol" in b.columns else b, 20, 60).drop("rvol").withColumn("trend", B.rolling_zscore("close", 30))
    b = folds.rsi(b, 30).withColumnRenamed("rsi", "rsi_30")
    b = folds.macd(b, 12, 26, 9).withColumnRenamed("macd", "macd_line").withColumnRenamed("histogram", "macd_hist")
    b = folds.directional_index(b, 30).withColumnRenamed("dx", "dx_30")
    b = written(b, "indicators")
    stationary = stationary_levels(b, LEVELS)
    out = b.drop(*LEVELS).join(stationary, ["symbol", "ts"], "left")
    out = out.join(F.broadcast(groups.select("symbol", "sector")), "symbol", "left") if groups is not None else out.withColumn("sector", F.lit("all"))  # a list of names
    at = out.withColumn("date", F.col("ts"))
    at = at.withColumns({"rank_ret_10": rank_share("ret_10", Window.partitionBy("date")) - 0.5, "z_rvol_20": sector_zscore("rvol_20")})
    return at.select("symbol", "ts", "close", *FEATURES, "vol_regime", "trend")


def labelled_rows(bars: DataFrame, features: DataFrame, threshold: float, k: float, floor: float, hold: int) -> DataFrame:
    """A row for every event with all features: symbol, pos, exit, FEATURES, vol_regime, trend, label (0 or 1: direction), fwd
    (return to the exit), meta (0 or 1: the side of momentum over hold bars paid), side_fwd (return of that side).

    Events are those of a cumulative sum of log returns past threshold; barriers are max(k * sigma, floor) away, sigma of 20
    bars, and positions may be held over night, hold bars at most."""
    w = series()
    b = bars.select("symbol", "ts", "close").withColumn("ret", B.log_return())
    b = b.withColumns({"sigma": rolling(F.stddev_samp("ret"), "ret", 20), "side": B.side_by_momentum(hold), "pos": (F.row_number().over(w) - 1).cast("int")})
    b = b.withColumn("end", F.max("pos").over(Window.partitionBy("symbol")))
    b = written(folds.cusum(b, threshold), "events")
    hits = b.where("event <> 0").select("symbol", "ts", "pos", "close", "sigma", "side", "end")
    t = L.meta_label(L.triple_barrier(hits, b.select("symbol", "pos", "close"), k, floor, hold))
    ends = b.select("symbol", F.col("pos").alias("exit"), F.col("close").alias("_out"))
    t = t.join(ends, ["symbol", "exit"]).withColumn("fwd", F.col("_out") / F.col("close") - 1)
    x = features.select("symbol", "ts", *FEATURES, "vol_regime", "trend")
    rows = t.select("symbol", "ts", "pos", "exit", (F.col("label") > 0).cast("int").alias("label"), "fwd", "meta", (F.col("side") * F.col("fwd")).alias("side_fwd")).join(x, ["symbol", "ts"])
    return rows.dropna("any", subset=[*FEATURES, "vol_regime", "trend", "fwd"])


def pooled(rows: DataFrame, gap: int) -> DataFrame:
    """rows with id (0, 1, ...), start and stop: symbols follow one another on one clock, gap bars apart, so that no label of
    one overlaps those of another."""
    spans = rows.groupBy("symbol").agg((F.max("exit") + 1).alias("length"))
    clock = L.pooled_clock(spans, gap).select("symbol", "offset")
    at = rows.join(F.broadcast(clock), "symbol").withColumns({"start": F.col("offset") + F.col("pos"), "stop": F.col("offset") + F.col("exit")})  # a row a symbol
    return written(numbered(at.drop("offset"), ["start"], "id"), "pooled")


def arms(rows: DataFrame, members: E.Members, groups: int, test: int, embargo: float, cost: float, regimes: int = 2) -> DataFrame:
    """arm, median, mean, std, worst, negative, paths of the direct and the meta strategy on pooled() rows under combinatorial
    purged cross-validation, models and gates fitted anew in every split.

    direct: positions 2 p - 1 of the direction's probability, gated by regimes, earn fwd; meta: sizes of the probability that the
    side pays, nothing up to one half, earn side_fwd. Both pay cost times their size."""
    columns = ["vol_regime", "trend"]

    def arm(name: str, y: str, fwd: str, gated: bool, position: Callable) -> DataFrame:
        own = rows.select("id", "start", "stop", F.col(y).alias("y"), F.col(fwd).alias("fwd"), *FEATURES, *columns)
        paths = E.ensemble_paths(own, members, groups, test, embargo, cost, regimes=(columns, regimes) if gated else None, position=position)
        return V.path_distribution(paths.select("path", "ret")).withColumn("arm", F.lit(name))

    direct = arm("direct", "label", "fwd", True, lambda p: 2 * p - 1)
    return direct.unionByName(arm("meta", "meta", "side_fwd", False, bet_size))
