"""Queries that once ran over a part of their input: every group must be there, with the values of a plain loop."""

from __future__ import annotations

import datetime as dt
import math
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators.events import shuffled_drawdowns
from plumbline.operators.portfolio import hierarchical_weights
from plumbline.plans.registry import QUERIES
from plumbline.sources import views


def test_every_symbol_is_held(spark, sf):
    panel = views.panel(spark, sf).toPandas().sort_values("date")
    want = {}
    for symbol, p in panel.groupby("symbol"):
        held = 0.0
        for date, volume in zip(p["date"], p["volume"], strict=True):
            target = round(volume / 500.0, 4)
            held = target if abs(target - held) > 0.3 * 0.1 else held
            want[date, symbol] = round(held, 4)
    got = {(r["date"], r["symbol"]): r["held"] for r in QUERIES["r05_held_weights"](spark, sf).collect()}
    assert got == want and len({s for _, s in got}) == panel["symbol"].nunique() > 2


def test_every_user_has_folds(spark, sf):
    events = views.table(spark, sf, "events").toPandas().sort_values(["ts", "event_id"])
    want = set()
    for user, e in events.groupby("user_id"):
        start, n = list(e["ts"]), len(e)
        stop = [t + dt.timedelta(hours=6) for t in start]
        blocks = [b.tolist() for b in np.array_split(range(n), 5)]
        for fold, block in enumerate(b for b in blocks if b):
            a, b = start[block[0]], max(stop[i] for i in block)
            for i in range(n):
                if i in block:
                    want.add((user, fold, i, "test"))
                elif stop[i] < a or (start[i] > b and i > block[-1] + math.floor(n * 0.02)):
                    want.add((user, fold, i, "train"))
    rows = QUERIES["r20_purged_folds"](spark, sf).collect()
    assert {tuple(r[c] for c in ("user_id", "fold", "pos", "role")) for r in rows} == want and len(rows) == len(want)
    assert len({r["user_id"] for r in rows}) == events["user_id"].nunique() > 1


def test_the_hierarchical_book_holds_every_symbol(spark):
    sf = "/root/testdata/sf0.01"  # sf0.001 has ten symbols
    p = views.panel(spark, sf).toPandas().sort_values("date")
    p["ret"] = p["close"] / p.groupby("symbol")["close"].shift(1) - 1
    p["date"] = pd.to_datetime(p["date"])
    p = p.dropna(subset="ret").assign(year=lambda x: x["date"].dt.year, month=lambda x: x["date"].dt.month)
    wide = p.groupby(["year", "month", "symbol"])["ret"].mean().unstack()
    want = {}
    for year, m in wide.groupby(level="year"):
        cov = m.cov(min_periods=2)
        good = [s for s in cov.columns if cov.loc[s, s] > 0]
        weights = hierarchical_weights(cov.loc[good, good].fillna(0.0).to_numpy())
        want |= {(year, s): w for s, w in zip(good, weights, strict=True)}
    got = {(r["date"].year, r["symbol"]): r["weight"] for r in QUERIES["r17_hierarchical_book"](spark, sf).collect()}
    assert got.keys() == want.keys() and len({s for _, s in got}) == p["symbol"].nunique() > 12
    assert [k for k in want if abs(got[k] - want[k]) > 2e-6] == []


def test_every_event_and_order_is_studied(spark, sf):
    events = {r["event_id"] for r in views.table(spark, sf, "events").select("event_id").collect()}
    windows = [r["event_id"] for r in QUERIES["r26_event_windows"](spark, sf).select("event_id").collect()]
    assert sorted(windows) == sorted(events)
    quotes = {i for i in events if i % 3 == 0}
    for name in ("j05_as_of_backward", "j06_as_of_forward"):
        assert {r["event_id"] for r in QUERIES[name](spark, sf).select("event_id").collect()} | quotes == events
    close = {(r["symbol"], r["date"]): r["close"] for r in views.panel(spark, sf).collect()}
    days = {s: sorted(d for t, d in close if t == s) for s, _ in close}
    nation = {r["n_nationkey"]: r["n_name"] for r in views.table(spark, sf, "nation").collect()}
    home = {r["c_custkey"]: nation.get(r["c_nationkey"]) for r in views.table(spark, sf, "customer").collect()}
    want = {1: [], -1: []}
    for r in views.table(spark, sf, "orders").collect():
        s, day, sign = home.get(r["o_custkey"]), r["o_orderdate"].date(), 1 if r["o_orderkey"] % 2 == 0 else -1
        at = [next(iter(days.get(s, [])[bisect_left(days.get(s, []), x) :]), None) for x in (day, day + dt.timedelta(days=30))]
        if None not in at:
            want[sign].append(sign * (close[s, at[1]] / close[s, at[0]] - 1))
    got = {r["review"]: (r["legs"], r["net"]) for r in QUERIES["r22_index_changes"](spark, sf).collect()}
    assert got == {k: (len(v), pytest.approx(sum(v) / len(v) - 0.002, abs=2e-6)) for k, v in want.items()}


def test_every_symbol_is_shuffled(spark, sf):
    got = Counter(r["symbol"] for r in QUERIES["r27_shuffled_drawdowns"](spark, sf).collect())
    assert got == {r["symbol"]: 50 for r in views.bars(spark, sf).select("symbol").distinct().collect()} and len(got) > 1


def test_drawdowns_of_a_group_are_those_of_its_rows_alone(spark):
    rows = [(s, i, (i * 7 % 5 - 2.0) * k) for k, s in enumerate("ab", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, id long, ret double")
    both = {(r["symbol"], r["path"]): r["drawdown"] for r in shuffled_drawdowns(df, 4, 7, ("symbol",)).collect()}
    for s in "ab":
        alone = {(s, r["path"]): r["drawdown"] for r in shuffled_drawdowns(df.where(F.col("symbol") == s), 4, 7).collect()}
        assert alone.items() <= both.items() and len(alone) == 4
