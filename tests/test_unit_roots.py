"""The normal distribution against the standard library; unit-root tests against regressions in a loop."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import normal as N
from plumbline.operators import unit_roots as U
from plumbline.plans.registry import QUERIES
from plumbline.sources import views

from .compare import connect


def test_normal_distribution_and_inverse(spark):
    z = [i / 37 for i in range(-1500, 1501)]
    got = spark.createDataFrame([(x,) for x in z], "x double").select("x", N.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(math.isclose(r["p"], NormalDist().cdf(r["x"]), rel_tol=1e-9, abs_tol=1e-15) for r in got)
    p = [10.0**-k for k in range(1, 300, 7)] + [i / 1013 for i in range(1, 1013)]
    got = spark.createDataFrame([(x,) for x in p], "p double").select("p", N.normal_inverse(F.col("p")).alias("x")).collect()
    assert all(math.isclose(r["x"], NormalDist().inv_cdf(r["p"]), rel_tol=1e-12, abs_tol=1e-12) for r in got)
    odd = spark.createDataFrame([(0.0,), (1.0,), (None,), (-1.0,)], "p double").select(N.normal_inverse(F.col("p")), N.normal_cdf(F.lit(None).cast("double")))
    assert all(tuple(r) == (None, None) for r in odd.collect())
    con = connect("/root/testdata/sf0.001")
    for x in (-9.0, -1.3, 0.0, 0.4, 3.3, 8.1):
        assert math.isclose(con.execute(f"SELECT {N.normal_cdf_sql(f'({x})::DOUBLE')}").fetchone()[0], NormalDist().cdf(x), rel_tol=1e-9, abs_tol=1e-15)
    for x in (1e-20, 0.01, 0.3, 0.5, 0.99):
        assert math.isclose(con.execute(f"SELECT {N.normal_inverse_sql(f'{x}::DOUBLE')}").fetchone()[0], NormalDist().inv_cdf(x), rel_tol=1e-9, abs_tol=1e-12)


def regression(y, x):
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    return b, float(e @ e)


def loop_test(x, trend="c"):
    """lag, rows, statistic: by least squares on the rows themselves."""
    x = np.asarray(x, float)
    n = len(x)
    terms = {"n": 0, "c": 1, "ct": 2}[trend]
    limit = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - terms - 1))
    d = np.diff(x)

    def system(p, first):
        t = np.arange(first, len(d))
        columns = [x[t]] + [d[t - k] for k in range(1, p + 1)] + [np.ones(len(t)), t + 1.0][:terms]
        return d[t], np.column_stack(columns)

    best = []
    for p in range(limit + 1):
        y, m = system(p, limit)
        if len(y) <= m.shape[1]:
            break
        ssr = regression(y, m)[1]
        best.append((len(y) * (math.log(2 * math.pi) + math.log(ssr / len(y)) + 1) + 2 * m.shape[1], p))
    p = min(best)[1]
    y, m = system(p, p)
    b, ssr = regression(y, m)
    variance = ssr / (len(y) - m.shape[1]) * (np.linalg.inv(np.linalg.qr(m)[1])[0] ** 2).sum()
    return p, len(y), b[0] / math.sqrt(variance)


def series():
    rng = np.random.default_rng(9)
    out = {}
    for k, n in enumerate((8, 9, 15, 60, 251, 900)):
        e = rng.normal(size=n + 5)
        walk, short = np.cumsum(e), np.zeros(n + 5)
        for t in range(2, n + 5):
            short[t] = 0.5 * short[t - 1] - 0.3 * short[t - 2] + e[t]
        out[f"walk{k}"], out[f"short{k}"], out[f"high{k}"] = walk[5:], short[5:], 1e4 + np.cumsum(short)[5:]
    return out


@pytest.mark.parametrize("trend", ["n", "c", "ct"])
def test_lags_and_statistics_against_a_loop(spark, trend):
    all_ = series()
    rows = [(s, t, float(v)) for s, x in all_.items() for t, v in enumerate(x)]
    rows += [("gaps", t, float(v) if t % 3 else None) for t, v in enumerate(all_["walk4"])]
    rows += [("flat", t, 2.0) for t in range(40)] + [("few", t, float(t % 2)) for t in range(7)] + [("none", 0, None)]
    df = spark.createDataFrame(rows, "symbol string, ts int, x double").repartition(7)
    got = {r["symbol"]: r for r in U.augmented_dickey_fuller(df, "x", ["symbol"], "ts", trend).collect()}
    assert got.keys() == {*all_, "gaps", "flat"}
    assert got["flat"]["statistic"] is None and got["flat"]["p"] is None
    for s, x in (all_ | {"gaps": [v for t, v in enumerate(all_["walk4"]) if t % 3]}).items():
        lag, n, t = loop_test(x, trend)
        assert (got[s]["lag"], got[s]["n"]) == (lag, n), s
        assert got[s]["statistic"] == pytest.approx(t, rel=1e-7, abs=1e-8), s
    assert trend != "c" or got["short5"]["p"] < 0.01


def test_p_values_meet_the_critical_values(spark):
    """At the published asymptotic critical values p is near its level, and the two curves, fitted apart, nearly meet."""
    known = [("n", 1, -1.94, 0.05), ("c", 1, -3.43, 0.01), ("c", 1, -2.86, 0.05), ("c", 1, -2.57, 0.1), ("c", 2, -3.90, 0.01), ("c", 2, -3.34, 0.05), ("ct", 1, -3.41, 0.05)]
    for trend, of, t, level in known:
        p = spark.range(1).select(U.p_value(F.lit(t), trend, of)).first()[0]
        assert p == pytest.approx(level, rel=0.06)
    for (trend, of), (least, turn, most, *_) in U.SURFACES.items():
        f = lambda x: spark.range(1).select(U.p_value(F.lit(float(x)), trend, of)).first()[0]  # noqa: B023, E731
        assert f(turn) == pytest.approx(f(turn + 1e-6), abs=5e-3) and f(least - 1) == 0 and (most == math.inf or f(most + 1) == 1)


def test_least_order_against_a_loop(spark, sf):
    bars = views.bars(spark, sf).orderBy("symbol", "ts").toPandas()
    got = {r["symbol"]: r for r in QUERIES["r25_least_order"](spark, sf).collect()}
    for s, g in bars.groupby("symbol"):
        x, want = g["close"].to_numpy(), None
        for d in [i / 10 for i in range(11)]:
            w = [1.0]
            while abs(v := -w[-1] * (d - len(w) + 1) / len(w)) >= 0.01:
                w.append(v)
            f = [sum(a * b for a, b in zip(w, x[i::-1], strict=False)) for i in range(len(w) - 1, len(x))]
            if len(f) >= U.LEAST:
                t = loop_test(f)[2]
                if spark.range(1).select(U.p_value(F.lit(float(t)))).first()[0] < 0.05:
                    want = d
                    break
        assert got[s]["d"] == want, s


def test_cointegrated_pairs_against_a_loop(spark):
    rng = np.random.default_rng(2)
    n = 120
    base = np.cumsum(rng.normal(size=n)) * 0.02
    logs = {"a": base + 3, "b": 0.7 * base + 0.01 * rng.normal(size=n), "c": np.cumsum(rng.normal(size=n)) * 0.02, "d": base + np.cumsum(rng.normal(size=n)) * 0.005, "e": 2 * base + 0.02 * rng.normal(size=n), "flat": np.zeros(n)}
    rows = [(f"2024-{1 + t // 28:02d}-{1 + t % 28:02d}", s, float(np.exp(v))) for s, x in logs.items() for t, v in enumerate(x)]
    rows += [(r[0], "gap", r[2]) for r in rows[1:n]] + [(r[0], "bad", 0.0) for r in rows[:n]]
    prices = spark.createDataFrame(rows, "d string, symbol string, close double").withColumn("date", F.to_date("d"))
    want = []
    for a, b in itertools.combinations("abcde", 2):
        x, y = logs[a], logs[b]
        if abs(np.corrcoef(x, y)[0, 1]) < 0.7:
            continue
        m = np.column_stack([y, np.ones(n)])
        e = x - m @ np.linalg.lstsq(m, x, rcond=None)[0]
        lag, _, t = loop_test(e, "n")
        p = spark.range(1).select(U.p_value(F.lit(float(t)), "c", 2)).first()[0]
        if p <= 0.05:
            want.append((p, a, b, lag, e.std(ddof=1)))
    got = U.cointegrated_pairs(prices, 3).collect()
    want = sorted(want)[:3]
    assert len(want) == 3 and [(r["a"], r["b"], r["lag"]) for r in got] == [w[1:4] for w in want]
    assert [r["deviation"] for r in got] == pytest.approx([w[4] for w in want], rel=1e-8)
    assert U.cointegrated_pairs(prices.limit(0), 3).count() == 0
