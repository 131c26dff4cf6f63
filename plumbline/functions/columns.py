"""Column expressions that the operators are made of. Missing is NULL: NaN is mapped to it at the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import written


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of float columns becomes NULL, so that aggregates skip it."""
    floats = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(floats) if floats else df


def series(symbol: str = "symbol", ts: str = "ts") -> WindowSpec:
    """A symbol's rows in time order."""
    return Window.partitionBy(symbol).orderBy(ts)


def last_n(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or series()).rowsBetween(1 - n, 0)


def upto(w: WindowSpec | None = None) -> WindowSpec:
    return (w or series()).rowsBetween(Window.unboundedPreceding, 0)


def rolling(aggregate: Column, x: str | Column, n: int, w: WindowSpec | None = None, least: int | None = None) -> Column:
    """An aggregate over the last n rows; missing unless least (n) of them have a value."""
    frame = last_n(n, w)
    return F.when(F.count(col(x)).over(frame) >= (least or n), aggregate.over(frame))


def rolling_mean(x: str | Column, n: int, w: WindowSpec | None = None) -> Column:
    return rolling(F.avg(col(x)), x, n, w)


def rolling_std(x: str | Column, n: int, w: WindowSpec | None = None) -> Column:
    return rolling(F.stddev_samp(col(x)), x, n, w)


def rolling_quantile(x: str | Column, q: float, n: int, w: WindowSpec | None = None, least: int | None = None) -> Column:
    return rolling(F.percentile(col(x), F.lit(q)), x, n, w, least)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, missing where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return F.try_divide(x - mean, F.when(std != 0, std))


def rank_share(x: str | Column, over: WindowSpec) -> Column:
    """Average rank of ties over the number of values (0 to 1]; over has no order. Missing stays missing."""
    x = col(x)
    ranked = over.orderBy(x)
    # rank() counts missing values, which come first
    below = F.rank().over(ranked) - 1 - F.sum(F.when(x.isNull(), 1).otherwise(0)).over(over)
    ties = F.count(x).over(ranked.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), (below + (ties + 1) / 2) / F.count(x).over(over))


def summed(df: DataFrame, order: list[str], x: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds name: the sum of x (whole numbers) up to and with the row, in order, over all rows or those of its group by.

    Two levels, so that no task sees all rows or a whole group: rows are dealt by ranges of by and order, as many as there
    are shuffle partitions, into a written table; each range sums its own rows, and what the ranges before it hold of the
    group is added. Columns of by are never null."""
    keys = [*by, "_range"]
    dealt = df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    placed = written(dealt, "ranges")
    held = placed.groupBy(*keys).agg(F.sum(x).alias("_s"))  # a row for each range and group in it
    before = F.sum("_s").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(*keys, F.coalesce(before, F.lit(0)).alias("_before"))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("_own", F.sum(x).over(w)).join(held, keys).withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def numbered(df: DataFrame, order: list[str], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds name: 0, 1, ... in order over all rows or those of its group (order tells all rows apart), as summed() does."""
    return summed(df.withColumn("_one", F.lit(1)), order, "_one", name, by).withColumn(name, (F.col(name) - 1).cast("long")).drop("_one")
