"""Timelines that are refused, reviews that can't be traded, shuffled controls and the battery's parts."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import mechanisms as X
from plumbline.plans.registry import QUERIES

D = datetime.date


def test_timelines_are_checked(spark):
    ok = [(D(2024, 1, 1), D(2024, 1, 5)), (D(2024, 1, 3), D(2024, 1, 3))]
    frame = lambda rows: spark.createDataFrame(rows, "start date, stop date")
    assert X.checked_timeline(frame(ok)).count() == 2 and X.checked_timeline(frame([])).count() == 0
    for rows, said in (([(D(2024, 1, 2), D(2024, 1, 1))], "1 reversed"), ([*ok, ok[0]], "1 repeated"), ([(None, D(2024, 1, 1))], "1 open"), ([(D(2024, 1, 1), None)], "1 open")):
        with pytest.raises(X.TimelineError, match=said):
            X.checked_timeline(frame(rows))


def test_reviews_that_cannot_be_traded(spark):
    days = [D(2024, 1, d) for d in (2, 5, 9)]
    closes = {("a", 0): 10.0, ("a", 1): 11.0, ("a", 2): 12.0, ("b", 0): 20.0, ("b", 1): 18.0, ("b", 2): 9.0, ("c", 1): 5.0, ("z", 0): 0.0, ("z", 2): 4.0}
    panel = spark.createDataFrame([(days[k], s, c) for (s, k), c in closes.items()], "date date, symbol string, close double")
    reviews = [
        ("both", D(2024, 1, 1), D(2024, 1, 3), ["a"], ["b"]), ("late", D(2024, 1, 3), D(2024, 1, 20), ["a"], []), ("same", D(2024, 1, 3), D(2024, 1, 4), ["a"], []),
        ("part", D(2024, 1, 2), D(2024, 1, 9), ["a", "c", "z", "none"], None), ("none", D(2024, 1, 2), D(2024, 1, 9), ["c"], ["none"]),
    ]
    df = spark.createDataFrame(reviews, "review string, announced date, effective date, adds array<string>, deletes array<string>")
    got = {r["review"]: (r["start"], r["stop"], r["legs"], round(r["net"], 9)) for r in X.review_returns(df, panel, 0.01).collect()}
    assert got == {"both": (days[0], days[1], 2, round((0.1 + 0.1) / 2 - 0.01, 9)), "part": (days[0], days[2], 1, round(0.2 - 0.01, 9))}


def test_shuffles_keep_the_returns_and_hide_the_order(spark, sf):
    a = QUERIES["r29_shuffled_control"](spark, sf).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, QUERIES["r29_shuffled_control"](spark, sf).collect()))
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=400)) * 0.1 + rng.normal(size=400)  # follows itself in its own order
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "symbol string, ts int, ret double")
    sign = lambda w: F.signum(F.lag("ret").over(w))
    true = np.mean(np.sign(x[:-1]) * x[1:])
    gains = [r["gain"] for r in X.shuffled_control(df, sign, 30).collect()]
    expected = np.sign(x).mean() * x.mean()
    assert len(gains) == 30 and abs(np.mean(gains) - expected) < 4 * np.std(gains) / np.sqrt(30) + 0.02 and true > np.mean(gains) + 3 * np.std(gains)
    ahead = [r["gain"] for r in X.shuffled_control(df, lambda w: F.signum("ret"), 5).collect()]
    assert min(ahead) == pytest.approx(np.abs(x).mean())  # a strategy that looks at its own row earns whatever the order


def test_battery_passes_and_fails(spark):
    rng = np.random.default_rng(4)
    results = spark.createDataFrame([(f"s{i % 3}", i, float(v)) for i, v in enumerate(0.1 + 0.05 * rng.normal(size=90))], "symbol string, id long, ret double")
    variants = spark.createDataFrame([("base", 0.1), ("near", 0.08), ("far", -0.02)], "variant string, score double")
    control = spark.createDataFrame([(k, "s", float(v)) for k, v in enumerate(0.01 * rng.normal(size=40))], "seed long, symbol string, gain double")
    noisy = spark.createDataFrame([(0, 0.05), (1, 0.04)], "seed int, score double")
    limits = {"same_sign": 0.6, "held_out": 0.0, "noise": 0.0, "drawdown": 1.0, "control": 4.0}
    got = {r["part"]: r for r in X.battery(results, variants, "base", control, noisy, 20, limits).collect()}
    assert got.keys() == limits.keys() and all(r["passes"] for r in got.values())
    assert got["same_sign"]["value"] == pytest.approx(2 / 3) and got["noise"]["value"] == 0.04
    strict = {"same_sign": 0.9, "held_out": 1.0, "noise": 0.05, "drawdown": 0.0, "control": -1.0}
    again = X.battery(results.withColumn("ret", -F.col("ret")), variants, "base", control, noisy, 20, strict).collect()
    assert not any(r["passes"] for r in again)
    none = X.battery(results.limit(0), variants, "base", control.limit(0), noisy.limit(0), 5, limits).collect()
    assert {r["part"] for r in none if r["passes"]} <= {"same_sign"} and len(none) == 5
