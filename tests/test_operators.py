"""Edge semantics that the SQL comparison doesn't pin: prefixes, ties, missing values, stores, streams."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.columns import nan_to_null, rank_share, rolling_std
from plumbline.operators import bars as B
from plumbline.operators import cross_section as C
from plumbline.operators import folds, hygiene, joins, portfolio
from plumbline.operators import labeling as L
from plumbline.operators import validation as V
from plumbline.sources import archive
from plumbline.streaming.bars import hot_window, parse_ticks, run_once


def make_bars(spark, closes, symbol="A", start=dt.datetime(2024, 1, 1, 9, 0), minutes=15):
    rows = [(symbol, start + dt.timedelta(minutes=minutes * i), c, c + 1.0, c - 1.0, c, 100 + i) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, archive.BAR_SCHEMA)


def test_features_do_not_look_ahead(spark):
    rng = np.random.default_rng(0)
    bars = make_bars(spark, (100 * np.exp(rng.normal(0, 0.01, 80).cumsum())).tolist())
    cut = dt.datetime(2024, 1, 1, 9, 0) + dt.timedelta(minutes=15 * 50)

    def features(b):
        f = B.realized_volatility(B.average_true_range(b, 5), 5)
        f = f.withColumns({"z": B.rolling_zscore("close", 10), "w": B.winsorized("close", 10, 0.1, 0.9), "p": B.parkinson(5), "side": B.side_by_momentum(3)})
        return folds.rsi(folds.macd(f, 3, 6, 4), 5)

    whole = features(bars).where(F.col("ts") < F.lit(cut)).orderBy("ts").collect()
    prefix = features(bars.where(F.col("ts") < F.lit(cut))).orderBy("ts").collect()
    assert whole == prefix


def test_a_planted_leak_is_seen(spark):
    bars = make_bars(spark, [float(i * i % 17 + 1) for i in range(40)])
    cut = dt.datetime(2024, 1, 1, 9, 0) + dt.timedelta(minutes=15 * 20)
    leaky = lambda b: b.withColumn("x", F.col("close") - F.avg("close").over(C.Window.partitionBy("symbol")))
    a = leaky(bars).where(F.col("ts") < F.lit(cut)).orderBy("ts").collect()
    assert a != leaky(bars.where(F.col("ts") < F.lit(cut))).orderBy("ts").collect()


def test_nan_is_missing_and_partial_windows_are_missing(spark):
    df = spark.createDataFrame([("A", i, float("nan") if i == 2 else float(i)) for i in range(6)], "symbol string, ts long, x double")
    out = nan_to_null(df).withColumn("s", rolling_std("x", 3)).orderBy("ts").collect()
    assert [r["s"] is None for r in out] == [True, True, True, True, True, False]


def test_rank_share_ties_and_missing(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 3.0), (1, 1.0), (1, None)], "date int, x double")
    got = sorted(r[0] for r in df.select(rank_share("x", C.on_date())).where("`%s` is not null" % df.select(rank_share("x", C.on_date())).columns[0]).collect())
    assert got == pytest.approx([1 / 3, 2.5 / 3, 2.5 / 3])


def test_sector_of_one_is_missing(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "b", 2.0)], "date int, sector string, x double")
    out = df.select("sector", C.sector_zscore("x").alias("z")).collect()
    assert [r["z"] for r in out if r["sector"] == "a"] == [None]


def test_spike_is_measured_from_the_last_kept_bar(spark):
    bars = make_bars(spark, [100.0, 200.0, 101.0, 199.0, 102.0])
    reasons = [r["reason"] for r in folds.bad_ticks(bars, 20.0).orderBy("ts").collect()]
    assert reasons == [None, "spike", None, "spike", None]


def test_cusum_keeps_the_other_side(spark):
    df = spark.createDataFrame([("A", i, r) for i, r in enumerate([1.0, -0.5, 2.0, -3.0])], "symbol string, ts long, ret double")
    assert [r["event"] for r in folds.cusum(df, 2.0).orderBy("ts").collect()] == [0, 0, 1, -1]


def test_triple_barrier_tie_time_and_last_bar(spark):
    bars = L.session_ends(make_bars(spark, [100.0, 101.0, 110.0, 90.0, 95.0]))
    events = bars.withColumn("sigma", F.lit(0.05)).select("symbol", "ts", "pos", "close", "sigma", "end")
    got = {r["pos"]: (r["barrier"], r["label"]) for r in L.triple_barrier(events, bars, 1.0, 0.0, 10).collect()}
    assert got[0] == ("profit", 1) and got[2] == ("stop", -1) and got[3] == ("profit", 1) and 4 not in got


def test_as_of_boundaries(spark):
    left = spark.createDataFrame([("A", 1), ("A", 5), ("B", 5)], "symbol string, ts int")
    right = spark.createDataFrame([("A", 1, 10), ("A", 4, 40), ("A", 6, 60)], "symbol string, ts int, v int")
    back = {(r["symbol"], r["ts"]): r["v"] for r in joins.as_of(left, right, values=("v",)).collect()}
    assert back == {("A", 1): 10, ("A", 5): 40, ("B", 5): None}
    strict = {(r["symbol"], r["ts"]): r["v"] for r in joins.as_of(left, right, values=("v",), inclusive=False).collect()}
    assert strict[("A", 1)] is None
    ahead = {(r["symbol"], r["ts"]): r["v"] for r in joins.as_of(left, right, values=("v",), forward=True).collect()}
    assert ahead == {("A", 1): 10, ("A", 5): 60, ("B", 5): None}
    with pytest.raises(KeyError):
        joins.checked_lookup(left, right, ["symbol", "ts"])


def test_nights_are_no_gap(spark):
    day = make_bars(spark, [1.0, 1.0, 1.0]).unionByName(make_bars(spark, [1.0, 1.0], start=dt.datetime(2024, 1, 2, 9, 0)))
    late = make_bars(spark, [1.0], start=dt.datetime(2024, 1, 2, 10, 0))
    assert [(r["missing"]) for r in hygiene.gaps(day.unionByName(late), 15).collect()] == [2]


def test_membership_bounds_are_inclusive(spark):
    m = spark.createDataFrame([("A", dt.date(2024, 1, 1), dt.date(2024, 1, 31)), ("B", dt.date(2024, 1, 31), None)], "symbol string, start date, end date")
    assert {r[0] for r in hygiene.members_on(m, F.lit("2024-01-31").cast("date")).collect()} == {"A", "B"}
    assert {r[0] for r in hygiene.members_on(m, F.lit("2024-02-01").cast("date")).collect()} == {"B"}


def test_archive_is_immutable_and_versions_count_changes(spark, tmp_path):
    bars = make_bars(spark, [1.0, 2.0, 3.0])
    store = archive.ParquetArchive(spark, str(tmp_path / "a"))
    assert store.read("A", "2024-01-01", "2024-01-02").count() == 0
    store.write(bars)
    store.write(bars)
    assert store.read("A", "2024-01-01 09:15:00", "2024-01-01 09:30:00").count() == 2 and store.symbols() == ["A"]
    with pytest.raises(archive.ImmutableArchiveError):
        store.write(bars.withColumn("close", F.col("close") + 1))
    with pytest.raises(archive.SchemaError):
        archive.ensure_bars(bars.drop("volume"))
    versions = archive.VersionedStore(spark, str(tmp_path / "v"))
    assert [versions.write("A", bars), versions.write("A", bars), versions.write("A", bars.limit(2))] == [1, 1, 2]
    assert versions.read("A", 1).count() == 3 and versions.read("A").count() == 2
    with pytest.raises(KeyError):
        versions.read("A", 9)


def test_hierarchical_weights_sum_to_one_and_prefer_calm():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (500, 5)) * np.array([1, 1, 1, 1, 5])
    w = portfolio.hierarchical_weights(np.cov(x.T))
    assert w.sum() == pytest.approx(1) and w.argmin() == 4 and (w > 0).all()


def test_purging_leaves_no_overlap(spark):
    labels = spark.createDataFrame([(i, i, i + 3) for i in range(23)], "pos int, start int, stop int")
    rows = V.purged_folds(labels, 5, 0.1).collect()
    for fold in range(5):
        test = [r["pos"] for r in rows if r["fold"] == fold and r["role"] == "test"]
        train = [r["pos"] for r in rows if r["fold"] == fold and r["role"] == "train"]
        assert test == list(range(min(test), max(test) + 1)) and len(test) in (4, 5)
        assert all(t + 3 < min(test) or t > max(test) + 3 for t in train)


def test_probability_of_sharpe():
    assert V.probabilistic_sharpe(0.0, 0.0, 100, 0.0, 3.0) == pytest.approx(0.5)
    assert V.expected_best_sharpe(1.0, 1) == 0.0 and V.expected_best_sharpe(1.0, 100) == pytest.approx(2.53, abs=0.02)


def test_overfitting_is_low_for_a_true_edge(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i % 6, float(rng.normal(1.0 if s == "good" else 0.0, 1))) for s in ("good", "a", "b", "c") for i in range(240)]
    logits = V.overfitting_probability(spark.createDataFrame(rows, "strategy string, part int, ret double"), 6).collect()
    assert len(logits) == 20 and all(r["logit"] > 0 for r in logits)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    make_bars(spark, [1.0, 2.0, 3.0]).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close").write.parquet(str(src))
    stream = spark.readStream.schema("symbol string, ts timestamp, close double").parquet(str(src))
    out = run_once(hot_window(stream, 2), "hot", str(tmp_path / "c"), "update").collect()
    assert [(r["n"], r["last_close"]) for r in out] == [(2, 3.0)]
    raw = spark.createDataFrame([('{"instrument": 1, "last_price": 2.5, "last_quantity": 3}',), ('{"instrument": 9}',)], "value string")
    known, unknown = parse_ticks(raw, spark.createDataFrame([(1, "A")], "instrument long, symbol string"))
    row = known.first()
    assert (row["symbol"], row["last_price"], row["bids"]) == ("A", 2.5, []) and row["ts"] is not None and unknown.count() == 1
