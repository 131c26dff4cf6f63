"""One query end to end: events to the top names of each hour by risk-adjusted return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import rank_share, rolling_std
from ..operators.bars import log_return
from ..sources import views


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.bars(spark, sf_dir).withColumn("ret", log_return())
    bars = bars.withColumn("rvol", rolling_std("ret", 10)).where("rvol is not null")
    hour = Window.partitionBy("ts")
    ranked = bars.withColumn("score", rank_share(F.try_divide("ret", "rvol"), hour))
    n, place = F.count("score").over(hour), F.row_number().over(hour.orderBy(F.desc("score"), "symbol"))
    top = ranked.withColumns({"_n": n, "_p": place}).where(F.col("_p") <= F.greatest(F.lit(1), F.bround(F.col("_n") * 0.4)))
    return top.select("ts", "symbol", F.round("ret", 6).alias("ret"), F.round("rvol", 6).alias("rvol"), F.round("score", 6).alias("score"))
