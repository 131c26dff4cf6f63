"""The factor gate's books and active returns against a loop in pandas."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import factor_gate as G

SETUP = G.Setup(lookback=30, skip=5, window=10, share=0.5, name_cap=0.35, sector_cap=0.5, groups=4, test=2)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(17)
    days = [datetime.date(2023, 1, 2) + datetime.timedelta(days=i) for i in range(420)]
    rows = []
    for k in range(9):
        close = 50 * np.exp(np.cumsum(0.01 * rng.normal(size=len(days)) + 0.0002 * k))
        rows += [(d, f"n{k}", "xyz"[k % 3], float(c), float(1e4 * rng.random() + 1)) for d, c in zip(days, close, strict=True)]
    return spark.createDataFrame(rows, "date date, symbol string, sector string, close double, value double").repartition(5)


def test_books_and_active_returns_against_a_loop(spark, panel):
    combiners = {"both": {"momentum": 2.0, "reversal": -1.0}, "calm": {"low_vol": 1.0}}
    scores = G.factor_scores(panel, SETUP)
    p = panel.toPandas().sort_values(["symbol", "date"])
    by = p.groupby("symbol")["close"]
    p["ret"] = by.pct_change()
    p["momentum"] = by.shift(5) / by.shift(30) - 1
    p["reversal"] = -(p["close"] / by.shift(5) - 1)
    p["vol"] = p.groupby("symbol")["ret"].transform(lambda r: r.rolling(10).std())
    p["low_vol"] = -p["vol"]
    p["month"] = pd.to_datetime(p["date"]).dt.to_period("M")
    ends = p.groupby("month")["date"].max()
    p = p[p["date"].isin(ends)].copy()
    for f in ("momentum", "reversal", "low_vol"):
        g = p.groupby(["date", "sector"])[f]
        p[f] = (p[f] - g.transform("mean")) / g.transform("std")
    got = {(r["date"], r["symbol"]): r for r in scores.collect()}
    for r in p.itertuples():
        for f in ("momentum", "reversal", "low_vol"):
            a, b = got[r.date, r.symbol][f], getattr(r, f)
            assert (a is None and np.isnan(b)) or a == pytest.approx(b, abs=1e-9)
    held = G.books(scores, combiners, SETUP)
    books = {(r["combiner"], r["date"], r["symbol"]): r["weight"] for r in held.collect()}
    active = {(r["combiner"], r["start"]): r for r in G.active_returns(held, SETUP).collect()}
    for name in combiners:
        if name == "both":
            m, v = p["momentum"] * 2, -p["reversal"]
            weight = p["momentum"].notna() * 2.0 + p["reversal"].notna() * 1.0
            p["score"] = (m.fillna(0) + v.fillna(0)) / weight.replace(0, np.nan)
        else:
            p["score"] = p["low_vol"]
        before, last = {}, None
        dates = []
        for d, day in p.groupby("date"):
            able = day[day["score"].notna() & (day["vol"] > 0)]
            if len(able) < 3:
                continue
            dates.append(d)
            n = max(1, round(len(able) * 0.5))
            top = able.sort_values(["score", "symbol"], ascending=[False, True]).head(n)
            w = (1 / top["vol"]) / (1 / top["vol"]).sum()
            w = np.minimum(w, 0.35)
            total = w.groupby(top["sector"]).transform("sum")
            w = w * np.where(total > 0.5, 0.5 / total, 1.0)
            want = dict(zip(top["symbol"], w, strict=True))
            close = dict(zip(day["symbol"], day["close"], strict=True))
            for s in close:
                assert books[name, d, s] == pytest.approx(want.get(s, 0.0), abs=1e-9), (name, d, s)
            if last:
                r = {s: close[s] / last[1][s] - 1 for s in close}
                net = sum(before[s] * r[s] for s in before) - 0.0022 * last[2]
                a = active[name, last[0]]
                assert a["stop"] == d and a["net"] == pytest.approx(net, abs=1e-9)
                assert a["active"] == pytest.approx(net - np.mean(list(r.values())), abs=1e-9)
            moved = sum(abs(want.get(s, 0) - before.get(s, 0)) for s in close)
            before, last = want, (d, close, moved)
        assert {k[1] for k in books if k[0] == name} == set(dates) and len([k for k in active if k[0] == name]) == len(dates) - 1


def test_verdicts_name_what_failed(spark, panel):
    got = {r["combiner"]: r for r in G.verdicts(panel, {"equal": dict.fromkeys(G.FACTORS, 1.0), "calm": {"low_vol": 1.0}}, SETUP).collect()}
    assert got.keys() == {"equal", "calm"}
    for r in got.values():
        tests = {"median": r["median"] >= 0.3, "deflated": r["deflated"] >= 0.95, "worst": r["worst"] >= -0.5, "negative": r["negative"] <= 0.4, "max_sector": r["max_sector"] <= 0.6}
        assert set(filter(None, r["failed"].split(","))) == {k for k, ok in tests.items() if not ok}
        assert r["passes"] == all(tests.values()) and r["rebalances"] >= 8 and r["max_sector"] <= 0.5 + 1e-9
