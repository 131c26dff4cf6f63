"""As-of and interval joins by sorting once, without products of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, on: str = "ts", by: tuple[str, ...] = ("symbol",), values: tuple[str, ...] = (), forward: bool = False, inclusive: bool = True) -> DataFrame:
    """Left rows with the values of the right row of the same key at or before them (forward: at or after), else missing.

    Both sides are sorted together once per key: one shuffle, whatever the numbers of rows. Of equal right times the
    largest values win, backward; forward the smallest. Rows without a key or a time match none. Forward reads the order
    from its end, so that either way a row's value is carried along from the rows before it: a frame up to a group's end
    would be read anew for every row.
    """
    rank = (1 if inclusive else -1) * (-1 if forward else 1)
    carried = F.struct(*values)
    a = left.select(F.struct(*left.columns).alias("_row"), *by, F.col(on).alias("_on"), F.lit(rank).alias("_side"), F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("_v"))
    b = right.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *by, F.col(on).alias("_on"), F.lit(0).alias("_side"), carried.alias("_v")).dropna(subset=[*by, "_on"])
    order = [F.col(c).desc() if forward else F.col(c).asc() for c in ("_on", "_side", "_v")]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.when(F.col("_on").isNotNull(), F.last("_v", ignorenulls=True).over(w))
    return a.unionByName(b).withColumn("_f", found).where(F.col("_row").isNotNull()).select("_row.*", *(F.col(f"_f.{v}").alias(v) for v in values))


def checked_lookup(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that must find every left key; costs an extra action."""
    if not left.join(right, on, "left_anti").isEmpty():
        raise KeyError(f"keys of {on} without a match")
    return left.join(right, on)


def positions(df: DataFrame, by: str = "symbol", ts: str = "ts", name: str = "pos") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(ts)) - 1)
