"""Simulations, datasets, files and relations against plain loops."""

from __future__ import annotations

import datetime as dt
import io
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.columns import numbered, summed
from plumbline.operators import dataset, hygiene, relations, simulation
from plumbline.operators import folds as folds_
from plumbline.operators import validation as V
from plumbline.plans.registry import QUERIES
from plumbline.sources import exchange, views

DAY = dt.date(2024, 1, 1)


def days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


def test_simulated_books_against_a_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for book in ("x", "y"):
        legs, equity, begun, last = {}, 1000.0, False, {}
        for i, d in enumerate(days(40)):
            reb = i % 7 == 3
            price = {s: 10 * math.exp(rng.gauss(0, 0.1)) for s in "abc"}
            weight = {s: rng.random() for s in "abc"}
            total = sum(weight.values())
            weight = {s: w / total if s != "c" or i % 2 else 0.0 for s, w in weight.items()}
            for s in "abc":
                if legs.get(s):
                    legs[s] *= price[s] / last[s]
            last = price
            equity = sum(legs.values()) or equity
            if reb:
                target = {s: weight[s] * equity for s in "abc"}
                cost = 0.0
                for s in "abc":
                    delta = target[s] - legs.get(s, 0.0)
                    if abs(delta) >= 1e-9:
                        v = abs(delta)
                        toll = v * (0.0000325 + 0.000001)
                        cost += v * 8 / 2 / 1e4 + toll * 1.18 + (v * 0.00015 if delta > 0 else v * 0.1 / 1e4 + 15.93)
                equity -= cost
                legs = {s: t * equity / sum(target.values()) for s, t in target.items()}
                begun = True
            want[book, d] = equity if begun else 1000.0
            rows += [(book, d, s, price[s], weight[s] if reb else None, 8.0, 0.1) for s in "abc"]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "book string, date date, symbol string, price double, weight double, spread_bps double, tax_bps double")
    got = {(r["book"], r["date"]): r["equity"] for r in simulation.simulated(df, 1000.0).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert simulation.simulated(df.limit(0), 1000.0).count() == 0


def test_engines_that_differ_are_told(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "t int, x double")
    assert simulation.disagreement(a, a, ["t"], ["x"]).first().asDict() == {"rows": 2, "x": 0.0}
    assert simulation.disagreement(a, a.withColumn("x", F.col("x") + 0.5), ["t"], ["x"]).first()["x"] == 0.5
    assert simulation.disagreement(a, a.where("t = 1"), ["t"], ["x"]).first()["rows"] == -1


def test_bands_hold_weights(spark):
    rows = [("a", d, w) for d, w in zip(days(6), [0.1, 0.11, 0.2, 0.19, 0.0, 0.0], strict=True)]
    got = folds_.banded_weights(spark.createDataFrame(rows, "symbol string, date date, weight double"), 0.25).orderBy("date").collect()
    assert [r["held"] for r in got] == [0.1, 0.1, 0.2, 0.2, 0.0, 0.0]


def test_rotation_without_scores_is_cash(spark):
    rows = [(DAY, "a", 1.0, 0.2, False), (DAY, "b", 2.0, 0.1, False), (DAY, "c", None, 0.1, False), (days(2)[1], "a", None, 0.2, True), (days(3)[2], "a", 1.0, None, True)]
    ranked = spark.createDataFrame(rows, "date date, symbol string, score double, vol double, risk_off boolean")
    got = {(r["date"], r["symbol"]): r["weight"] for r in simulation.rotation_weights(ranked, 2, 0.4, "cash").collect()}
    assert got[DAY, "a"] == pytest.approx(1 / 3) and got[DAY, "b"] == pytest.approx(2 / 3) and got[DAY, "c"] == 0 and got[DAY, "cash"] == pytest.approx(0)
    assert got[days(2)[1], "cash"] == 1 and got[days(3)[2], "a"] == pytest.approx(0.6) and got[days(3)[2], "cash"] == pytest.approx(0.4)


def test_numbers_over_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(-5, 400)]), i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, x int").repartition(7)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = {r["b"]: (r["n"], r["s"]) for r in summed(numbered(df, ["a", "b"], "n"), ["a", "b"], "x", "s").collect()}
    total = 0
    for i, r in enumerate(order):
        total += r[2]
        assert got[r[1]] == (i, total)
    assert numbered(df.limit(0), ["a", "b"], "n").count() == 0
    stamps = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i * 7 % 50), i) for i in range(50)], "t timestamp_ntz, i int")
    assert [r["n"] for r in numbered(stamps, ["t", "i"], "n").orderBy("t", "i").collect()] == list(range(50))


def test_groups_of_a_combination_are_contiguous(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(23)], "t int, net double")
    got = {r["t"]: r["grp"] for r in V.dealt_groups(df, 4, ["t"]).collect()}
    assert [got[i] for i in range(23)] == [g for g, n in enumerate([6, 6, 6, 5]) for _ in range(n)]
    assert V.combinatorial_results(df, 4, 2, ["t"]).count() == 23 * 3


def zipped(name, text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, text)
    return out.getvalue()


def test_daily_files_of_both_layouts(spark, tmp_path):
    legacy = "SYMBOL , SERIES,OPEN,HIGH,LOW,CLOSE,TOTTRDQTY,TOTTRDVAL,TOTALTRADES,ISIN\n AAA ,EQ,1,2,0.5,1.5,100,150.5,7, IN1\nBBB,BE,1,1,1,1,1,1,1,IN2\n\n"
    new = "TckrSymb,SctySrs,ISIN,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd\nCCC,EQ ,IN3,10,-,9,9.5,,x,3\n"
    (tmp_path / "2024-01-02.zip").write_bytes(zipped("a.CSV", legacy))
    (tmp_path / "2024-07-09.zip").write_bytes(zipped("b.csv", new))
    day = F.to_date(F.regexp_extract("file", r"(\d{4}-\d\d-\d\d)\.zip", 1))
    rows = {r["symbol"]: r for r in exchange.daily_files(spark, str(tmp_path), day).collect()}
    assert rows.keys() == {"AAA", "CCC"}
    assert tuple(rows["AAA"]) == ("AAA", "IN1", "EQ", dt.datetime(2024, 1, 2, 15, 30), 1.0, 2.0, 0.5, 1.5, 100, 150.5, 7)
    assert tuple(rows["CCC"])[3:] == (dt.datetime(2024, 7, 9, 15, 30), 10.0, None, 9.0, 9.5, 0, None, 3)
    (tmp_path / "2024-07-10.zip").write_bytes(zipped("c.csv", "what,is,this\n1,2,3\n"))
    with pytest.raises(Exception, match="unknown daily file"):
        exchange.daily_files(spark, str(tmp_path), day).collect()


def test_review_log_refuses_unknown_actions(spark):
    log = spark.createDataFrame([("r", DAY, DAY, "add", "a"), ("r", DAY, DAY, " Delete", " b "), ("r", DAY, DAY, "ADD", "a")], "review string, announced date, effective date, action string, symbol string")
    assert exchange.review_events(log).first().asDict() == {"review": "r", "announced": DAY, "effective": DAY, "adds": ["a"], "deletes": ["b"]}
    with pytest.raises(Exception, match="unknown action"):
        exchange.review_events(log.withColumn("action", F.lit("swap"))).collect()


def test_factors_of_actions(spark):
    bars = spark.createDataFrame([("a", dt.datetime(2024, 1, d, 10), 10.0, 11.0, 9.0, 10.0 + d, 101) for d in range(1, 5)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long")
    schema = "symbol string, ex_date date, kind string, ratio double, amount double"
    act = spark.createDataFrame([("a", days(3)[2], "split", 2.0, None), ("a", days(4)[3], "dividend", None, 1.3), ("a", DAY, "split", 5.0, None)], schema)
    got = {r["ex_date"]: (r["factor"], r["volume_factor"]) for r in hygiene.action_factors(act, bars).collect()}
    assert got == {days(3)[2]: (0.5, 2.0), days(4)[3]: (pytest.approx(1 - 1.3 / 13.0), 1.0)}
    out = {r["ts"].day: r for r in hygiene.adjusted_bars(bars, hygiene.action_factors(act, bars)).collect()}
    assert out[1]["close"] == pytest.approx(11 * 0.5 * 0.9) and out[1]["volume"] == 202 and out[3]["close"] == pytest.approx(13 * 0.9) and out[4]["close"] == 14.0
    with pytest.raises(Exception, match="leaves no price"):
        hygiene.action_factors(act.withColumn("amount", F.lit(99.0)), bars).collect()


def test_dickey_fuller_and_the_least_difference(spark, sf):
    rng = np.random.default_rng(2)
    walk, noise = np.cumsum(rng.normal(size=800)), rng.normal(size=800)
    rows = [(s, i, float(x)) for s, v in (("walk", walk), ("noise", noise)) for i, x in enumerate(v)]
    got = {r["symbol"]: r for r in relations.dickey_fuller(spark.createDataFrame(rows, "symbol string, ts int, x double"), "x", ["symbol"], "ts").collect()}
    for s, v in (("walk", walk), ("noise", noise)):
        b, d = v[:-1], np.diff(v)
        a = np.stack([np.ones_like(b), b], 1)
        beta, rest, *_ = np.linalg.lstsq(a, d, rcond=None)
        t = beta[1] / math.sqrt(rest[0] / (len(d) - 2) * np.linalg.inv(a.T @ a)[1, 1])
        assert got[s]["statistic"] == pytest.approx(t, rel=1e-6)
    assert got["noise"]["stationary"] and not got["walk"]["stationary"]
    df = spark.createDataFrame([("walk", i, float(x)) for i, x in enumerate(walk)], "symbol string, ts int, close double")
    least = relations.least_difference(df, "close", [0.0, 0.5, 1.0], 0.01).first()["d"]
    assert least in (0.5, 1.0)


def test_sequential_draws_overlap_less(spark):
    spans = [("s", i, i // 4, i // 4 + 30) for i in range(60)] + [("s", 100 + i, 200 + 40 * i, 205 + 40 * i) for i in range(8)]
    df = spark.createDataFrame(spans, "symbol string, id long, start int, stop int")
    draws = relations.sequential_draws(df, 1)
    first = sorted(map(tuple, draws.collect()))
    assert first == sorted(map(tuple, relations.sequential_draws(df, 1).collect())) and len(first) == len(spans)
    rng = random.Random(0)
    plain = [spark.createDataFrame([("s", i, rng.choice(spans)[1]) for i in range(len(spans))], "symbol string, draw int, id long") for _ in range(3)]
    u = lambda x: relations.draw_uniqueness(x, df).first()["uniqueness"]
    assert u(draws) > max(map(u, plain))


def test_dataset_drops_incomplete_rows(spark):
    features = spark.createDataFrame([("a", i, dt.datetime(2024, 1, 1, i), None if i == 1 else float(i)) for i in range(6)], "symbol string, pos int, ts timestamp_ntz, x double")
    labelled = spark.createDataFrame([("a", 0, 2, 1), ("a", 1, 2, -1), ("a", 3, 5, 1), ("a", 4, 9, 1)], "symbol string, pos int, exit int, label int")
    got = {r["t0"].hour: r for r in dataset.assembled(features, labelled, ["x"]).collect()}
    assert got.keys() == {0, 3} and got[0]["weight"] == pytest.approx((1 + 0.5 + 0.5) / 3) and got[3]["t1"].hour == 5
    assert dataset.label_tag(hold=8, k=0.5) == "hold=8_k=0.5"


def test_random_walk_is_the_same_again_and_keeps_its_mean(spark):
    a = exchange.random_walk_bars(spark, ["p", "q"], ["2024-01-01"], 200, 0.01, 4)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, exchange.random_walk_bars(spark, ["p", "q"], ["2024-01-01"], 200, 0.01, 4).repartition(5).collect()))
    steps = exchange.random_walk_bars(spark, [f"s{i}" for i in range(300)], ["2024-01-01"], 50, 0.01, 4).groupBy("symbol").agg(F.max_by("close", "ts").alias("c"))
    assert steps.agg(F.avg("c")).first()[0] == pytest.approx(100, abs=2)


def test_deflated_ratios_against_numpy(spark, sf):
    from statistics import NormalDist

    bars = views.bars(spark, sf).orderBy("symbol", "ts").toPandas()
    rows = {}
    for s, p in bars.groupby("symbol"):
        r = np.diff(np.log(p["close"].to_numpy()))
        c = r - r.mean()
        rows[s] = (r.mean() / r.std(ddof=1), len(r), (c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2)
    ratios = [x[0] for x in rows.values()]
    var, n, q = np.var(ratios, ddof=1), len(ratios), NormalDist().inv_cdf
    best = math.sqrt(var) * ((1 - 0.5772156649015329) * q(1 - 1 / n) + 0.5772156649015329 * q(1 - 1 / (n * math.e)))
    got = {r["symbol"]: r for r in QUERIES["a14_deflated_sharpe"](spark, sf).collect()}
    for s, (sr, m, skew, kurt) in rows.items():
        spread = math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr)
        assert got[s]["psr"] == pytest.approx(NormalDist().cdf(sr * math.sqrt(m - 1) / spread), abs=1e-6)
        assert got[s]["dsr"] == pytest.approx(NormalDist().cdf((sr - best) * math.sqrt(m - 1) / spread), abs=1e-6)


def test_overfitting_probability_against_a_loop(spark, sf):
    from itertools import combinations

    bars = views.bars(spark, sf).orderBy("symbol", "ts").toPandas()
    bars["ret"] = bars.groupby("symbol")["close"].transform(lambda c: np.log(c).diff())
    bars["part"] = (bars["ts"] - np.datetime64("2024-01-01")).dt.days % 8
    bars = bars.dropna(subset="ret")
    lost = 0
    combos = list(combinations(range(8), 4))
    sr = lambda x: x["ret"].mean() / x["ret"].std(ddof=1)
    for c in combos:
        inside = bars[bars["part"].isin(c)].groupby("symbol").apply(sr, include_groups=False)
        outside = bars[~bars["part"].isin(c)].groupby("symbol").apply(sr, include_groups=False)
        share = outside.rank()[inside.idxmax()] / (len(outside) + 1)
        lost += math.log(share / (1 - share)) <= 0
    r = QUERIES["a30_overfitting_probability"](spark, sf).first()
    assert r["combos"] == len(combos) and r["pbo"] == pytest.approx(lost / len(combos), abs=1e-6)


def test_noise_has_its_deviation_and_importance_finds_the_score(spark, sf):
    scores = views.scores(spark, sf).toPandas().set_index("id")["p"]
    noisy = QUERIES["r28_noise"](spark, sf).toPandas().set_index("id")["p"]
    z = (noisy - scores) / (0.1 * scores.std(ddof=0))
    assert len(noisy) == len(scores) and abs(z.mean()) < 4 / math.sqrt(len(z)) and 0.7 < z.std() < 1.3
    loss = {r["feature"]: r["loss"] for r in QUERIES["m07_permutation_importance"](spark, sf).collect()}
    assert loss.keys() == {"p", "q"} and all(math.isfinite(v) for v in loss.values())


def descend(x, y, rounds, l2=1.0, rate=0.5):
    a = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(a.shape[1])
    for _ in range(rounds):
        g = a.T @ (1 / (1 + np.exp(-a @ beta)) - y)
        g[1:] += l2 * beta[1:]
        beta = beta - rate * g / len(y)
    return beta


def folds_of(n, k, span, embargo):
    out = []
    for block in np.array_split(np.arange(n), k):
        if len(block):
            a, b, last = block[0], block[-1] + span, block[-1]
            train = [i for i in range(n) if i + span < a or (i > b and i > last + math.floor(n * embargo))]
            out.append((list(block), train))
    return out


@pytest.fixture(scope="module")
def scored(spark, sf):
    s = views.scores(spark, sf).orderBy("id").toPandas()
    x = np.stack([s["p"], s["id"] % 7, s["p"] ** 2], 1).astype(float)
    return (x - x.mean(0)) / x.std(0), s["y"].to_numpy(float)


def test_out_of_fold_models_against_a_loop(spark, sf, scored):
    x, y = scored
    members = {"one": [0], "two": [1], "all": [0, 1, 2]}
    want, both = {}, {}
    for fold, (test, train) in enumerate(folds_of(len(y), 5, 3, 0.01)):
        scores = {}
        for name, columns in (members | {"pq": [0, 1]}).items():
            beta = descend(x[np.ix_(train, columns)], y[train], 10)
            scores[name] = 1 / (1 + np.exp(-(beta[0] + x[np.ix_(test, columns)] @ beta[1:])))
        share = lambda v: np.array([((v < z).sum() + ((v == z).sum() + 1) / 2) / len(v) for z in v])
        mean = sum(share(np.round(scores[m], 12)) for m in members) / 3
        want |= {(i, fold): scores["pq"][j] for j, i in enumerate(test)}
        both |= {(i, fold): mean[j] for j, i in enumerate(test)}
    got = {(r["id"], r["fold"]): r["p"] for r in QUERIES["m06_out_of_fold"](spark, sf).collect()}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}
    got = {(r["id"], r["fold"]): r["p"] for r in QUERIES["m05_ensemble"](spark, sf).collect()}
    assert got.keys() == both.keys() and np.mean([abs(got[k] - both[k]) < 0.02 for k in both]) > 0.98  # near ties may order otherwise


def test_tuning_takes_the_least_loss(spark, sf, scored):
    x, y = scored
    x = x[:, :2]
    want = {}
    for l2 in (0.1, 10.0):
        for rounds in (3, 6):
            losses = []
            for test, train in folds_of(len(y), 3, 3, 0.01):
                beta = descend(x[train], y[train], rounds, l2)
                p = 1 / (1 + np.exp(-(beta[0] + x[test] @ beta[1:])))
                losses.append(-np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)))
            want[l2, rounds] = np.mean(losses)
    got = QUERIES["m11_tuned"](spark, sf).collect()
    assert {(r["l2"], r["rounds"]): r["log_loss"] for r in got} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    assert [(r["l2"], r["rounds"]) for r in got if r["best"]] == [min(want, key=want.get)]


def test_logistic_and_isotonic_fits_against_numpy(spark, sf, scored):
    x, y = scored
    beta = descend(x[:, :1], y, 10)
    got = [r["prob"] for r in QUERIES["m02b_logistic"](spark, sf).orderBy("id").collect()]
    assert got == pytest.approx((1 / (1 + np.exp(-(beta[0] + x[:, 0] * beta[1])))).tolist(), abs=1e-6)
    fit = {r["id"]: r["prob"] for r in QUERIES["m03_isotonic"](spark, sf).collect()}
    s = views.scores(spark, sf).toPandas().groupby("p").agg(y=("y", "mean"), n=("y", "size"), id=("id", "first")).reset_index()
    blocks = []
    for v, n in zip(s["y"], s["n"], strict=True):
        blocks.append([v, n, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks[-1]
            blocks[-1] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
    flat = [v for v, _, k in blocks for _ in range(k)]
    assert [fit[i] for i in s["id"]] == pytest.approx(flat, abs=1e-9)


def test_gates_of_regimes(spark):
    from plumbline.operators import ensemble

    df = spark.createDataFrame([(0.7, 0.3), (0.5, 0.5), (0.2, 0.8), (None, None)], "a double, b double")
    got = [r[0] for r in df.select(ensemble.regime_gate([F.col("a"), F.col("b")], [2.0, 0.0], 0.6)).collect()]
    assert got == [2.0, 1.0, 0.0, 1.0]
    rng = np.random.default_rng(0)
    rows = [(float(rng.normal(m, 1)), g) for m, g in ((-10, 1.0), (10, -1.0)) for _ in range(80)]
    fit, gates = ensemble.fitted_gate(spark.createDataFrame(rows, "x double, g double"), ["x"], "g", 2)
    assert gates == [1.0, 0.0] and fit["mean"][0, 0] < 0 < fit["mean"][1, 0]


def test_depth_sink_writes_each_snapshot_once(spark, tmp_path):
    from plumbline.streaming.bars import depth_sink

    src = str(tmp_path / "in")
    rows = [("a", dt.datetime(2024, 1, 1, 10, i % 3), [(1.0, 2)]) for i in range(6)] + [("b", dt.datetime(2024, 1, 2, 10), [])]
    spark.createDataFrame(rows, "symbol string, ts timestamp, bids array<struct<price:double,quantity:long>>").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    for _ in range(2):
        depth_sink(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 4 and out.where("symbol = 'a' and date = '2024-01-01'").count() == 3


def test_selection_score_against_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist(), int(i % 3)) for i in range(60)]
    from plumbline.operators import models

    df = spark.createDataFrame(rows, "id long, embedding array<double>, prediction int")
    got = {r["id"]: r["score"] for r in models.selection_score(df).collect()}
    x, k = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    centres = [x[k == j].mean(0) for j in range(3)]
    best = max(centres, key=lambda c: c.mean())
    assert got == {i: pytest.approx(-np.linalg.norm(x[i] - best)) for i in range(60)}
    one = models.selection_score(df.withColumn("prediction", F.lit(0)), thesis=[1, 0, 0, 0, 0, 0])
    assert {r["id"]: r["score"] for r in one.collect()} == {i: pytest.approx(x[i, 0]) for i in range(60)}


def test_correlations_in_blocks_of_names(spark, monkeypatch):
    from plumbline.operators import cross_section

    monkeypatch.setattr(cross_section, "NAMES", 4)
    monkeypatch.setattr(cross_section, "DAYS", 7)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 11))
    x[rng.random((30, 11)) < 0.3] = np.nan
    rows = [(DAY + dt.timedelta(days=i), f"n{j}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(30) for j in range(11)]
    got = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in cross_section.correlations(spark.createDataFrame(rows, "date date, symbol string, ret double")).collect()}
    want = {}
    for i in range(11):
        for j in range(11):
            if f"n{i}" < f"n{j}":
                both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
                want[f"n{i}", f"n{j}"] = (both.sum(), pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1]))
    assert got == want
