"""Event labels that depend on the path after an event, and weights for overlapping labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import upto


def first_touches(events: DataFrame, bars: DataFrame, hold: int) -> DataFrame:
    """Adds up, down (positions of the first close at or beyond each barrier) and last (the final position looked at).

    events: symbol, pos, upper, lower, end (last position of the session); bars: symbol, pos, close. Each event is
    dealt to the bars after it, to end and at most hold, and joined by symbol and position: an equi-join whose size is
    events times hold at most.
    """
    last = F.least(F.col("pos") + hold, F.col("end"))
    ahead = events.where(last > F.col("pos")).withColumn("last", last).withColumn("at", F.explode(F.sequence(F.col("pos") + 1, last)))
    met = ahead.join(bars.select(F.col("symbol").alias("_s"), F.col("pos").alias("_p"), F.col("close").alias("_c")), (F.col("symbol") == F.col("_s")) & (F.col("at") == F.col("_p")))
    keys = [c for c in events.columns]
    return met.groupBy(*keys, "last").agg(
        F.min(F.when(F.col("_c") >= F.col("upper"), F.col("at"))).alias("up"),
        F.min(F.when(F.col("_c") <= F.col("lower"), F.col("at"))).alias("down"),
        F.max_by("_c", "at").alias("last_close"),
    )


def triple_barrier(events: DataFrame, bars: DataFrame, k: float, floor: float, hold: int) -> DataFrame:
    """Adds barrier (profit, stop, time), exit, label to events (symbol, pos, close, sigma, end).

    The barriers lie max(k * sigma, floor) away; a tie is a stop; at the time barrier the return's sign is the label.
    Events without sigma or on the last bar have no label and are absent.
    """
    width = F.greatest(k * F.col("sigma"), F.lit(floor))
    ready = events.where("sigma is not null").withColumns({"upper": F.col("close") * (1 + width), "lower": F.col("close") * (1 - width)})
    t = first_touches(ready, bars, hold)
    stop = F.col("down").isNotNull() & (F.col("up").isNull() | (F.col("down") <= F.col("up")))
    barrier = F.when(stop, "stop").when(F.col("up").isNotNull(), "profit").otherwise("time")
    t = t.withColumn("barrier", barrier)
    label = F.when(F.col("barrier") == "profit", 1).when(F.col("barrier") == "stop", -1).otherwise(F.signum(F.col("last_close") - F.col("close")))
    return t.withColumns({"exit": F.coalesce(F.when(stop, F.col("down")), F.col("up"), F.col("last")), "label": label.cast("int")})


def meta_label(labelled: DataFrame, side: str = "side") -> DataFrame:
    """Adds meta: whether the bet on side made money (a side's own barrier, or a gain at the time barrier)."""
    gain = F.col(side) * F.when(F.col("barrier") == "time", F.col("last_close") - F.col("close")).otherwise(F.col("label"))
    return labelled.withColumn("meta", F.when((F.col(side) != 0) & (gain > 0), 1).otherwise(0))


def session_ends(bars: DataFrame) -> DataFrame:
    """Adds pos (0, 1, ... in time order) and end (the position of the day's last bar)."""
    w = Window.partitionBy("symbol").orderBy("ts")
    return bars.withColumn("pos", F.row_number().over(w) - 1).withColumn("end", F.max("pos").over(Window.partitionBy("symbol", F.to_date("ts"))))


def concurrency(labels: DataFrame) -> DataFrame:
    """symbol, pos, c: how many labels (symbol, start, stop: positions) are alive at each position."""
    return labels.select("symbol", F.explode(F.sequence("start", "stop")).alias("pos")).groupBy("symbol", "pos").agg(F.count("*").alias("c"))


def uniqueness(labels: DataFrame) -> DataFrame:
    """Adds uniqueness: the mean of 1 / concurrency over a label's positions (labels: symbol, id, start, stop)."""
    spread = labels.select("symbol", "id", F.explode(F.sequence("start", "stop")).alias("pos"))
    return spread.join(concurrency(labels), ["symbol", "pos"]).groupBy("symbol", "id").agg(F.avg(1 / F.col("c")).alias("uniqueness"))


def return_attribution(labels: DataFrame, returns: DataFrame) -> DataFrame:
    """symbol, id, weight: the size of the sum of returns (symbol, pos, ret) over concurrency; weights sum to their number."""
    spread = labels.select("symbol", "id", F.explode(F.sequence("start", "stop")).alias("pos"))
    shared = spread.join(concurrency(labels), ["symbol", "pos"]).join(returns, ["symbol", "pos"])
    raw = shared.groupBy("symbol", "id").agg(F.abs(F.sum(F.col("ret") / F.col("c"))).alias("raw"))
    total = raw.agg(F.sum("raw").alias("s"), F.count("*").alias("n"))
    return raw.crossJoin(total).select("symbol", "id", F.try_divide(F.col("raw") * F.col("n"), "s").alias("weight"))


def time_decay(weighted: DataFrame, last: float) -> DataFrame:
    """Adds decay: linear in a symbol's cumulative uniqueness, 1 at the newest label and last at the oldest end."""
    w = Window.partitionBy("symbol").orderBy("id")
    x = F.sum("uniqueness").over(upto(w))
    total = F.sum("uniqueness").over(Window.partitionBy("symbol"))
    slope = F.try_divide(F.lit(1.0 - last), total) if last >= 0 else F.try_divide(F.lit(1.0), (last + 1) * total)
    return weighted.withColumn("decay", F.greatest(1 - slope * total + slope * x, F.lit(0.0)))


def pooled_clock(spans: DataFrame, gap: int) -> DataFrame:
    """Adds offset to spans (symbol, length): symbols follow one another by name, gap apart. A row for each symbol."""
    w = Window.partitionBy(F.lit(0)).orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("offset", F.coalesce(F.sum(F.col("length") + gap).over(w), F.lit(0)))
