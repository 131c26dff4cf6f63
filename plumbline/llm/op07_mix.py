"""Mixing sources to target weights: balanced sampling by the cube method."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, table
from .textbytes import NON_SPACE, counts, pieces

#: A document, and so a source, is taken at most this many times.
MOST = 3
#: Units of a source that one task balances together.
BLOCK = 1024
#: Open units of a source that are settled by choice, not by chance.
LANDING = 14


@F.arrow_udf(T.LongType())
def _words(texts: pa.Array) -> pa.Array:
    found = [counts(p.spans(NON_SPACE)[2], p.rows) for p in pieces(texts)]
    return pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())


def word_count(text: str | Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null: 0."""
    return _words(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, docs, target for every source of sized (source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. They share the sum of all sizes by weight; a target
    stops at MOST times its source's size and the excess is shared by weight among the others, until none is above.
    With r = cap / weight, the shares stop in the order of r: a source stops if what is left for it and all later
    ones, shared by weight, gives it its cap or more. One row for each source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    one = Window.partitionBy(F.lit(0))  # a row of some 100 bytes for each source: names, not documents
    weighed = totals.withColumn("weight", ((F.row_number().over(one.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1).cast("double"))
    cap = (MOST * F.col("source_size")).cast("double")
    by = one.orderBy(cap / F.col("weight"), F.asc_nulls_last("source"))
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    later = by.rowsBetween(0, Window.unboundedFollowing)
    level = weighed.withColumns(
        {
            "cap": cap,
            "left": F.sum("source_size").over(one) - F.coalesce(F.sum(cap).over(earlier), F.lit(0.0)),
            "weights": F.sum("weight").over(later),
        }
    ).withColumn("stops", F.col("left") * F.col("weight") >= F.col("cap") * F.col("weights"))
    rest = (F.sum("source_size").over(one) - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(one), F.lit(0.0))) / F.sum(
        F.when(~F.col("stops"), F.col("weight"))
    ).over(one)
    return level.select("source", "source_size", "docs", F.when(F.col("stops"), F.col("cap")).otherwise(F.least(F.col("cap"), rest * F.col("weight"))).alias("target"))


def flight(x: list[float], size: list[int], rng: random.Random, stop: int = 0) -> None:
    """Move the inclusion probabilities x, in place, along vectors that change neither the sum of x nor of x times
    size, until fewer than three lie between 0 and 1, or stop of them. Each step is a fair game, so every unit keeps
    its probability."""
    window: list[int] = []
    units = [i for i, v in enumerate(x) if 0 < v < 1]
    for n, new in enumerate(units):
        if len(window) + len(units) - n <= stop:
            return
        window.append(new)
        while len(window) >= 2:
            i, j = window[:2]
            if size[i] == size[j]:
                step = [(i, 1.0), (j, -1.0)]
            elif len(window) == 3:
                k = window[2]
                if size[k] in (size[i], size[j]):
                    step = [(k, 1.0), (i if size[k] == size[i] else j, -1.0)]
                else:
                    step = [(i, float(size[k] - size[j])), (j, float(size[i] - size[k])), (k, float(size[j] - size[i]))]
            else:
                break
            up = min((1 - x[a]) / u if u > 0 else -x[a] / u for a, u in step)
            down = min(x[a] / u if u > 0 else (x[a] - 1) / u for a, u in step)
            go = up if rng.random() * (up + down) < down else -down
            for a, u in step:
                v = x[a] + go * u
                x[a] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
            before = len(window)
            window = [a for a in window if 0 < x[a] < 1]
            if len(window) == before:  # rounding left every unit just inside
                a = min(window, key=lambda a: min(x[a], 1 - x[a]))
                x[a] = float(round(x[a]))
                window.remove(a)


def landing(x: list[float], size: list[int]) -> None:
    """Settle the last open units (LANDING at most): of all choices whose number of documents is within one of what
    their probabilities ask for, that whose words come nearest to it; the first such choice."""
    todo = [i for i, v in enumerate(x) if 0 < v < 1]
    if not todo:
        return
    picks = (np.arange(1 << len(todo))[:, None] >> np.arange(len(todo))) & 1
    p, z = np.array([x[i] for i in todo]), np.array([size[i] for i in todo], float)
    docs, words = np.abs(picks.sum(1) - p.sum()), np.abs(picks @ z - p @ z)
    for i, v in zip(todo, picks[np.lexsort((words, docs > 1))[0]], strict=True):
        x[i] = float(v)


def _balance(seed: int):
    def run(key: tuple, units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["deal", "doc_id", "size"], kind="stable")
        x, size = units["x"].tolist(), units["size"].tolist()
        rng = random.Random(f"{seed} {key}")
        last = units["last"].iloc[0]
        flight(x, size, rng, LANDING if last else 0)
        if last:
            landing(x, size)
        return units.assign(x=x)

    return run


#: The id is a string of digits, as pandas would make a long beside a null a float.
_UNIT = "doc_id string, source string, size long, source_size long, target double, whole long, x double, deal long, block long, last boolean"


def _told_apart(units: DataFrame, seed: int) -> DataFrame:
    """units, where rows that share an id and a size in a source get a deal of their own each.

    They are exchangeable, so any numbers do as long as they are the same set in every run: repeated rows are counted
    and generated anew from the counts, without a sort or a group that holds them.
    """
    rest = [c for c in units.columns if c != "deal"]
    many = units.groupBy(*rest).agg(F.count("*").alias("rows"), F.first("deal").alias("deal"))
    # a row's copies are numbered in two steps, so that neither step makes an array of more than the root of their number
    side = F.ceil(F.sqrt("rows")).cast("int")
    some = many.withColumn("a", F.explode(F.sequence(F.lit(0), side - 1))).withColumn("side", side)
    each = some.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("side") - 1))).withColumn("copy", F.col("a") * F.col("side") + F.col("b")).where("copy < rows")
    deal = F.when(F.col("rows") == 1, F.col("deal")).otherwise(F.xxhash64("deal", "copy", F.lit(seed)))
    return each.select(*rest, deal.alias("deal"))


def mix(sized: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of sized (doc_id, source, size).

    A source at rate r = target / source_size takes every document floor(r) times and samples the rest: fractional
    inclusion probabilities r - floor(r) are moved through the null space of two constraints, the number of documents
    and of words. The units of a source are dealt into blocks of about BLOCK by a hash, each block leaves two open
    units at most, those of all blocks are dealt again, and in a source's last block the landing settles them. So no
    task sees a whole source, and a source's words miss its target by less than its largest document. Rows of size 0 take 0.
    Repeated rows are units like others, dealt apart; null ids are allowed; a null source is one; no rows give none. Reruns agree.
    """
    shares = materialize(targets(sized), "targets")
    right = shares.select(F.col("source").alias("_source"), "source_size", "docs", "target")
    joined = sized.select(F.col("doc_id").cast("long"), "source", F.col("size").cast("long")).join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    units = joined.select(
        F.col("doc_id").cast("string").alias("doc_id"), "source", "size", "source_size", "target",
        F.floor(rate).alias("whole"),
        F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0).alias("x"),
        F.xxhash64("doc_id", "size", F.lit(seed)).alias("deal"),
        F.col("docs").alias("open"),
    )
    units = _told_apart(units, seed)
    done = None
    turn = 0
    while True:
        blocks = F.ceil(F.col("open") / BLOCK)
        dealt = units.withColumns({"block": F.pmod("deal", blocks), "last": blocks == 1}).drop("open")
        ran = dealt.groupBy("source", "block").applyInPandas(_balance(seed + turn), _UNIT)
        state = materialize(ran, "units")
        settled = state.where("x = 0 or x = 1")
        done = settled if done is None else done.union(settled)
        still = state.where("x > 0 and x < 1").drop("block", "last")
        turn += 1
        left = still.groupBy("source").agg(F.count("*").alias("open")).withColumnRenamed("source", "_source")
        units = still.withColumn("deal", F.xxhash64("deal", F.lit(turn))).join(left, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        if still.isEmpty():
            break
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("x").cast("long"))).alias("taken"))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(sizes(table(spark, sf_dir, "documents")), "sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken", "source")
