"""The composed matrix against its single operators, and pooled rows and arms against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.columns import rolling_mean
from plumbline.operators import bars as B
from plumbline.operators import boosting as G
from plumbline.operators import complete as P
from plumbline.operators import evaluation as E
from plumbline.operators import folds
from plumbline.operators import unit_roots as U


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(21)
    rows = []
    for s, n in (("a", 400), ("b", 260), ("c", 60)):
        close = 100 * np.exp(np.cumsum(0.01 * rng.normal(size=n)))
        for i in range(n):
            o, c = close[i - 1] if i else 100.0, close[i]
            rows.append((s, i, float(o), float(max(o, c) * 1.002), float(min(o, c) / 1.002), float(c), int(rng.integers(50, 900))))
    df = spark.createDataFrame(rows, "symbol string, i int, open double, high double, low double, close double, volume long")
    ts = F.timestamp_add("HOUR", F.col("i"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return df.select("symbol", ts.alias("ts"), "open", "high", "low", "close", "volume").repartition(4).cache()


@pytest.fixture(scope="module")
def matrix(bars):
    return P.feature_matrix(bars).cache()


def test_columns_are_those_of_the_operators(bars, matrix):
    assert len(P.FEATURES) == 21 and matrix.count() == bars.count()
    single = folds.rsi(bars, 30).withColumnRenamed("rsi", "rsi_30").select("symbol", "ts", "rsi_30", B.log_return("close", 5).alias("ret_5"))
    both = single.join(matrix.select("symbol", "ts", F.col("rsi_30").alias("r"), F.col("ret_5").alias("q")), ["symbol", "ts"])
    assert both.where("not (rsi_30 <=> r) or not (ret_5 <=> q)").isEmpty()
    ranks = matrix.where("rank_ret_10 is not null").groupBy("ts").agg(F.sum("rank_ret_10").alias("s"), F.count("*").alias("n")).collect()
    assert all(r["s"] == pytest.approx(0.5) for r in ranks)


def test_levels_are_differenced_by_the_least_order(spark, bars, matrix):
    level = bars.withColumn("x", rolling_mean("close", 60))
    orders = U.least_order(level, "x", list(P.ORDERS), P.THRESHOLD)
    chosen = {r["symbol"]: r["d"] for r in orders.collect()}
    got = {(r["symbol"], r["ts"]): r["sma_60"] for r in matrix.collect()}
    plain = {r["symbol"]: [] for r in orders.collect()}
    for r in level.orderBy("symbol", "ts").collect():
        plain[r["symbol"]].append((r["ts"], r["x"]))
    for s, rows in plain.items():
        x = [(t, v) for t, v in rows if v is not None]
        if len(x) < P.SHORT:
            want = dict(x)
        else:
            d = chosen[s]
            for attempt in (d, P.FALLBACK):
                w = folds.frac_diff_weights(P.FALLBACK if attempt is None else attempt, P.THRESHOLD)
                want = {x[i][0]: sum(a * x[i - k][1] for k, a in enumerate(w)) for i in range(len(w) - 1, len(x))}
                if len(want) >= P.KEPT * len(x):
                    break
        assert {t: got[s, t] for t, _ in rows if got[s, t] is not None} == pytest.approx(want, abs=1e-9), s


def test_pooled_labels_do_not_overlap_between_symbols(bars, matrix):
    rows = P.pooled(P.labelled_rows(bars, matrix, 0.02, 1.0, 0.01, 10), 15)
    got = rows.orderBy("id").toPandas()
    assert list(got["id"]) == list(range(len(got))) and len(got) > 40 and (got["stop"] > got["start"]).all()
    close = {s: g.sort_values("ts")["close"].to_numpy() for s, g in bars.toPandas().groupby("symbol")}
    for r in got.itertuples():
        c = close[r.symbol]
        assert r.fwd == pytest.approx(c[r.exit] / c[r.pos] - 1) and r.exit - r.pos <= 10
        side = np.sign(c[r.pos] - c[r.pos - 10])
        assert r.side_fwd == pytest.approx(side * r.fwd) and r.meta == int(side * r.fwd > 0)
    last = None
    for s, g in got.groupby("symbol", sort=True):
        assert last is None or g["start"].min() >= last + 15, s
        last = g["stop"].max()


def test_arms_size_their_positions(bars, matrix):
    rows = P.pooled(P.labelled_rows(bars, matrix, 0.02, 1.0, 0.01, 10), 15)
    members = {"tree": G.Boosted(P.FEATURES, rounds=2, depth=2, least_rows=5), "line": G.Logistic(("ret_5", "rsi_30"), rounds=3)}
    found = {r["arm"]: r for r in P.arms(rows, members, 4, 2, 0.01, 0.001).collect()}
    assert found.keys() == {"direct", "meta"} and all(r["paths"] == 3 and r["worst"] <= r["median"] for r in found.values())
    own = rows.select("id", "start", "stop", F.col("meta").alias("y"), F.col("side_fwd").alias("fwd"), *P.FEATURES)
    plain = {(r["split"], r["id"]): r for r in E.ensemble_paths(own, members, 4, 2, 0.01, 0.001).collect()}
    sized = E.ensemble_paths(own, members, 4, 2, 0.01, 0.001, position=P.bet_size).collect()
    returns = {r["id"]: r["fwd"] for r in own.collect()}
    for r in sized:
        assert r["position"] == pytest.approx(max(0.0, plain[r["split"], r["id"]]["position"]))
        assert r["ret"] == pytest.approx(r["position"] * (returns[r["id"]] - 0.001))
