"""Runs appended by many writers at once; deflated ratios as columns; draws by a sum tree against the plain loop."""

from __future__ import annotations

import json
import math
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import relations as R
from plumbline.operators import validation as V
from plumbline.plans.registry import QUERIES
from plumbline.sources.runs import RunLog


def test_writers_never_share_a_number(spark, tmp_path):
    def write(k):
        log = RunLog(spark, str(tmp_path / "runs"))
        return [log.append(f"w{k}-{i}", {"k": k}, {"sharpe": k + i / 10}, at=float(i)) for i in range(6)]

    with ThreadPoolExecutor(8) as pool:
        numbers = [n for own in pool.map(write, range(8)) for n in own]
    assert sorted(numbers) == list(range(1, 49))
    log = RunLog(spark, str(tmp_path / "runs"))
    rows = log.runs().collect()
    assert sorted(r["run"] for r in rows) == list(range(1, 49)) and {r["name"] for r in rows} == {f"w{k}-{i}" for k in range(8) for i in range(6)}
    assert all(r["metrics"]["sharpe"] == int(r["name"][1]) + int(r["name"][3]) / 10 and r["params"] == {"k": r["name"][1]} for r in rows)
    t = log.trials("sharpe").first()
    assert t["trials"] == 48 and t["variance"] == pytest.approx(np.var([k + i / 10 for k in range(8) for i in range(6)], ddof=1))
    assert log.append("discarded") == 49 and log.trials("sharpe").first()["trials"] == 49  # it counts whatever it measured
    assert not [f for f in (tmp_path / "runs").iterdir() if f.name.startswith("_")]
    assert json.loads((tmp_path / "runs/00000049.json").read_text())["metrics"] == {}


def test_writers_through_the_store_that_only_spark_reaches(spark, tmp_path):
    """The same by rename, as on a store without links."""

    class Remote(RunLog):
        def __init__(self, spark, path):
            super().__init__(spark, path)
            self.local = None

    log = Remote(spark, f"file://{tmp_path}/r")
    assert [log.append(str(k)) for k in range(3)] == [1, 2, 3]
    (tmp_path / "r/00000004.json").write_text('{"name": "other"}')
    own = "_mine"
    log._write(own, '{"name": "mine"}')
    assert not log._named(own, "00000004.json") and log._named(own, "00000005.json")
    assert {r["run"]: r["name"] for r in log.runs().collect()} == {1: "0", 2: "1", 3: "2", 4: "other", 5: "mine"}
    assert RunLog(spark, str(tmp_path / "none")).runs().count() == 0 and RunLog(spark, str(tmp_path / "none")).trials("x").first()["trials"] == 0


def test_deflated_ratios_as_columns(spark, sf):
    cases = [(0.1, 250, -0.5, 4.0, 0.01, 20), (-0.2, 60, 0.0, 3.0, 0.5, 1), (1.5, 30, 2.0, 9.0, 0.2, 5000), (0.0, 2, 0.0, 1.0, 0.0, 3)]
    df = spark.createDataFrame(cases, "sr double, n long, skew double, kurtosis double, variance double, trials long")
    got = df.select(V.deflated_sharpe_of(*(F.col(c) for c in df.columns)).alias("d"), V.expected_best_sharpe_of(F.col("variance"), F.col("trials")).alias("b")).collect()
    for c, r in zip(cases, got, strict=True):
        assert r["d"] == pytest.approx(V.deflated_sharpe(*c), abs=1e-9) and r["b"] == pytest.approx(V.expected_best_sharpe(*c[4:]), abs=1e-9)
    r = QUERIES["r36_trials_and_deflation"](spark, sf).first()
    t = QUERIES["s36_trial_count"](spark, sf).first()
    assert r["trials"] == t["trials"] and 0 <= r["deflated"] <= 1 and math.isfinite(r["sharpe"])
    assert "collect" not in V.deflated_sharpe_of.__code__.co_names


def loop_draws(start, stop, seed):
    """Every draw looks at all labels."""
    a, b = np.asarray(start), np.asarray(stop)
    a, b = a - a.min(), b - a.min()
    rng = np.random.default_rng(seed)
    held, out = np.zeros(b.max() + 1), []
    for _ in range(len(a)):
        sums = np.concatenate(([0.0], np.cumsum(1 / (held + 1))))
        chance = (sums[b + 1] - sums[a]) / (b + 1 - a)
        i = int(rng.choice(len(a), p=chance / chance.sum()))
        held[a[i] : b[i] + 1] += 1
        out.append(i)
    return out


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 700])
def test_draws_equal_the_loop(n):
    rng = np.random.default_rng(n)
    start = rng.integers(5, 5 + 3 * n, n)
    stop = start + rng.integers(0, 25, n) + (rng.random(n) < 0.02) * 200
    assert R.sequence_of_draws(start, stop, 11).tolist() == loop_draws(start, stop, 11)


def test_a_hundred_thousand_labels():
    n = 100_000
    start = np.arange(n) * 3
    began = time.time()
    drawn = R.sequence_of_draws(start, start + 20, 1)
    assert len(drawn) == n and time.time() - began < 60
    assert len(np.unique(drawn)) > 0.65 * n  # plain draws leave 0.632
