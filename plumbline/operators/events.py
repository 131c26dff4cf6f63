"""Studies of dated events: surprises, windows around an event, baskets of index changes, resampled paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import numbered
from .joins import as_of


def surprise(actual: Column, expected: Column) -> Column:
    """Relative surprise; its sign where nothing was expected."""
    return F.when(expected == 0, F.signum(actual - expected)).otherwise(F.try_divide(actual - expected, F.abs(expected)))


def net_position_return(position: Column, gross: Column, cost: float) -> Column:
    return position * gross - F.abs(position) * cost


def position_of(p: Column) -> Column:
    return 2 * p - 1


def event_windows(events: DataFrame, prices: DataFrame, before: int, after: int) -> DataFrame:
    """Adds pre, reaction, drift to events (symbol, ts): returns over the rows before, to the next row, and after it.

    prices: symbol, ts, close. The base is the last row at or before the event."""
    w = Window.partitionBy("symbol").orderBy("ts")
    steps = prices.select(
        "symbol", "ts",
        (F.try_divide("close", F.lag("close", before).over(w)) - 1).alias("pre"),
        (F.try_divide(F.lead("close", 1).over(w), "close") - 1).alias("reaction"),
        (F.try_divide(F.lead("close", 1 + after).over(w), F.lead("close", 1).over(w)) - 1).alias("drift"),
    )
    return as_of(events, steps, values=("pre", "reaction", "drift"))


def basket_returns(changes: DataFrame, closes: DataFrame, cost: float) -> DataFrame:
    """review, legs, net: mean signed return from announced to effective of each review's changes
    (review, symbol, sign, announced, effective), less cost. Prices are those of the first date at or after each;
    closes: date, symbol, close. A leg without both prices is left out. Equal legs of a review are counted and priced once."""
    legs = changes.groupBy("review", "symbol", "sign", "announced", "effective").agg(F.count("*").alias("_n"))
    at = closes.select("symbol", F.col("date").alias("ts"), "close")
    enter = as_of(legs.withColumn("ts", F.col("announced")), at, values=("close",), forward=True).withColumnRenamed("close", "_a")
    leave = as_of(enter.withColumn("ts", F.col("effective")), at, values=("close",), forward=True).withColumnRenamed("close", "_b")
    legs = leave.withColumn("_r", F.col("sign") * (F.try_divide("_b", "_a") - 1)).where("_r is not null")
    return legs.groupBy("review").agg(F.sum("_n").alias("legs"), (F.sum(F.col("_r") * F.col("_n")) / F.sum("_n") - cost).alias("net"))


def shuffled_drawdowns(returns: DataFrame, n: int, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, path, drawdown of n random orders of each group's returns (by, id, ret); an order follows from a hash, so that
    reruns agree.

    Every path is one sort of all returns of its group: meant for a strategy's period returns."""
    paths = returns.sparkSession.range(n).select(F.col("id").alias("path"))
    dealt = returns.crossJoin(F.broadcast(paths)).withColumn("_o", F.xxhash64("path", "id", F.lit(seed)))  # n rows
    w = Window.partitionBy(*by, "path").orderBy("_o", "id").rowsBetween(Window.unboundedPreceding, 0)
    path = dealt.withColumn("_c", F.sum("ret").over(w))
    return path.withColumn("_d", F.max("_c").over(w) - F.col("_c")).groupBy(*by, "path").agg(F.max("_d").alias("drawdown"))


def noisy(df: DataFrame, x: str, level: float, seed: int) -> DataFrame:
    """x plus level population deviations of noise from a hash of the row's id (id, x)."""
    scale = F.col("_scale")
    spread = df.agg(F.stddev_pop(x).alias("_scale"))  # one row
    u = [(F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(1_000_003)) + 0.5) / 1_000_003 for k in (0, 1)]
    normal = F.sqrt(-2 * F.ln(u[0])) * F.cos(6.283185307179586 * u[1])
    return df.join(F.broadcast(spread)).withColumn(x, F.col(x) + level * scale * normal).drop("_scale")


def permutation_importance(scores: DataFrame, features: list[str], predict, seed: int = 0) -> DataFrame:
    """feature, loss: how much the mean squared error of predict(frame) -> column grows when a feature's values are
    dealt to other rows. scores: id, y and features. Rows are matched by their place in two hash orders."""
    spark = scores.sparkSession
    base = scores.agg(F.avg(F.pow(predict(scores) - F.col("y"), 2)).alias("e")).first()["e"]
    out = []
    for k, f in enumerate(features):
        a = numbered(scores.withColumn("_h", F.xxhash64("id", F.lit(seed))), ["_h", "id"], "_p").drop("_h")
        b = numbered(scores.select(F.col(f).alias("_x"), "id", F.xxhash64("id", F.lit(seed + k + 1)).alias("_h")), ["_h", "id"], "_p").select("_x", "_p")
        moved = a.join(b, "_p").withColumn(f, F.col("_x"))
        e = moved.agg(F.avg(F.pow(predict(moved) - F.col("y"), 2)).alias("e")).first()["e"]
        out.append((f, float(e - base) if e is not None and base is not None else None))
    return spark.createDataFrame(out, "feature string, loss double")


def trade_cost(value: Column, sells: Column, rate: float, spread: float, flat: float) -> Column:
    """Cost of a trade: a rate and half the spread of its value, and a flat charge when it sells."""
    return value * rate + value * spread / 2 + F.when(sells, flat).otherwise(0.0)
