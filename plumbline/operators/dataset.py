"""Assembly of training rows: features and regimes of labelled events, weights, version tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labeling as L


def assembled(features: DataFrame, labelled: DataFrame, needed: list[str], decay: float | None = None) -> DataFrame:
    """symbol, t0, t1, the needed columns, label, weight of every labelled event that has all of them.

    features: symbol, pos, ts and needed; labelled: symbol, pos, label, exit (positions). weight is the label's average
    uniqueness among all labels of its symbol, those without features too, and by decay if that is given. Left joins keep
    the events; incomplete rows are dropped last."""
    spans = labelled.select("symbol", F.col("pos").alias("id"), F.col("pos").alias("start"), F.col("exit").alias("stop"))
    weights = L.uniqueness(spans)
    if decay is not None:
        weights = L.time_decay(weights, decay).withColumn("uniqueness", F.col("uniqueness") * F.col("decay"))
    weights = weights.select("symbol", F.col("id").alias("pos"), F.col("uniqueness").alias("weight"))
    ends = features.select("symbol", F.col("pos").alias("exit"), F.col("ts").alias("t1"))
    rows = labelled.select("symbol", "pos", "exit", "label").join(features.select("symbol", "pos", F.col("ts").alias("t0"), *needed), ["symbol", "pos"], "left")
    rows = rows.join(ends, ["symbol", "exit"], "left").join(weights, ["symbol", "pos"], "left")
    return rows.dropna("any", subset=[*needed, "t0", "t1"]).select("symbol", "t0", "t1", *needed, "label", "weight")


def version_tags(bars: DataFrame) -> DataFrame:
    """symbol, tag: the range of days and a prefix of the hash of what a symbol's bars add up to."""
    g = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"), F.sum("volume").alias("v"))
    digest = F.substring(F.sha1(F.concat_ws("|", "symbol", "n", "v")), 1, 8)
    return g.select("symbol", F.concat_ws("-", F.date_format("a", "yyyyMMdd"), F.date_format("b", "yyyyMMdd"), digest).alias("tag"))


def label_tag(**parameters: float) -> str:
    """A tag of the label's parameters, in order of their names."""
    return "_".join(f"{k}={v:g}" for k, v in sorted(parameters.items()))
