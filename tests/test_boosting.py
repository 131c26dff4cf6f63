"""Boosted trees and logistic models of many splits against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import boosting as G


def table(n=900, seed=4):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.exponential(size=n) ** 3, np.full(n, 2.0)])
    x[rng.random(n) < 0.1, 0] = np.nan
    z = np.nan_to_num(x[:, 0]) * (x[:, 1] > 2) + (x[:, 2] > 1) - 0.5
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * z))).astype(int)
    return x, y, rng.choice([0.5, 1.0, 2.0], n)


NAMES = ["a", "b", "c", "flat"]


def frame(spark, x, y, w, parts=5):
    rows = [(i, int(y[i]), float(w[i]), *(None if math.isnan(v) else float(v) for v in x[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "id long, y int, w double, a double, b double, c double, flat double").repartition(parts)


def roles_of(spark, n, splits=3):
    """Every split tests a third, and trains and checks the others."""
    rows = [(s, i, "test" if i % splits == s else "check" if i % 7 == 0 else "train") for s in range(splits) for i in range(n)]
    return spark.createDataFrame(rows, "split int, id long, role string")


def loop_trees(bins, y, w, member, columns, check=None):
    """The same trees, each found by trying every cut of every node."""
    unit = G.UNIT
    share = (w * y).sum() / w.sum()
    f = np.full(len(y), math.log(share / (1 - share)))
    start, trees, losses = f[0], [], []

    def term(g, h):
        return max(abs(g / unit) - member.l1, 0.0) ** 2 / (h / unit + member.l2)

    def leaf(at, g, h):
        g, h = g[at].sum() / unit, h[at].sum() / unit
        return -member.rate * math.copysign(max(abs(g) - member.l1, 0.0), g) / (h + member.l2)

    def best(at, g, h):
        found = None
        for j in columns:
            for cut in range(bins[:, j].max() + 1):
                left = at & (bins[:, j] <= cut)
                right = at & ~left
                if left.sum() < member.least_rows or right.sum() < member.least_rows:
                    continue
                gain = term(g[left].sum(), h[left].sum()) + term(g[right].sum(), h[right].sum()) - term(g[at].sum(), h[at].sum())
                if gain > max(member.least_gain, 1e-12) and (found is None or gain > found[0]):
                    found = (gain, j, cut, left, right)
        return found

    for _ in range(member.rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = np.rint(w * (p - y) * unit), np.rint(w * p * (1 - p) * unit)
        whole = np.ones(len(y), bool)
        leaves = [(whole, 0)]
        if member.growth == "level":
            after, closed = leaves, []
            while after:
                at, depth = after.pop(0)
                cut = best(at, g, h) if depth < member.depth else None
                if cut:
                    after += [(cut[3], depth + 1), (cut[4], depth + 1)]
                else:
                    closed.append(at)
        else:
            open_, closed = [(best(whole, g, h), whole)], []
            while len(open_) < member.leaves and any(c for c, _ in open_):
                k = max((i for i, (c, _) in enumerate(open_) if c), key=lambda i: open_[i][0][0])
                cut, _ = open_.pop(k)
                open_ += [(best(side, g, h), side) for side in cut[3:]]
            closed = [at for _, at in open_]
        step = np.zeros(len(y))
        for at in closed:
            step[at] = leaf(at, g, h)
        f = f + step
        trees.append(f.copy())
    return start, trees


@pytest.mark.parametrize("member", [G.Boosted(("a", "b", "c", "flat"), rounds=5, least_rows=15), G.Boosted(("a", "c"), "leaf", rounds=4, leaves=6, l1=0.05, l2=2.0, rate=0.3, least_rows=10)])
def test_trees_against_a_loop(spark, member):
    x, y, w = table()
    rows = G.prepared(frame(spark, x, y, w), NAMES, roles_of(spark, len(y)), "w")
    fitted = G.fit(rows, NAMES, {"m": member})
    columns = [NAMES.index(f) for f in member.features]
    for s in range(3):
        train = np.array([i % 3 != s and i % 7 != 0 for i in range(len(y))])
        bins = G.binned(x, fitted[s, "m"].cuts)
        start, want = loop_trees(bins[train], y[train], w[train], member, columns)
        own = fitted[s, "m"]
        assert own.start == pytest.approx(start, abs=1e-12) and len(own.trees) == member.rounds
        own_score = own.score(x[train], columns)
        assert own_score == pytest.approx(want[-1], abs=1e-9)


def test_trees_do_not_depend_on_partitions(spark):
    x, y, w = table(400)
    members = {"level": G.Boosted(("a", "b", "c"), rounds=6, row_share=0.7, feature_share=0.6, seed=3), "leaf": G.Boosted(("a", "c"), "leaf", rounds=4)}
    found = []
    for parts in (1, 7):
        rows = G.prepared(frame(spark, x, y, w, parts), NAMES, roles_of(spark, len(y)), "w").repartition(parts)
        found.append(G.fit(rows, NAMES, members))
    a, b = found
    assert all((p == q).all() for k in a for p, q in zip(a[k].cuts, b[k].cuts, strict=True))
    assert a.keys() == b.keys() and all(a[k].trees == b[k].trees for k in a)
    sampled = {t.feature[0] for t in a[0, "level"].trees}
    assert len(sampled - {-1}) > 1  # features differ from tree to tree


def test_early_stop_keeps_the_best_trees(spark):
    x, y, w = table(600)
    y = np.random.default_rng(1).integers(0, 2, len(y))  # nothing to learn: more trees are worse
    rows = G.prepared(frame(spark, x, y, w), NAMES, roles_of(spark, len(y)), "w")
    fitted = G.fit(rows, NAMES, {"m": G.Boosted(("a", "b", "c"), rounds=40, rate=0.5, least_rows=5, patience=3)})
    for s in range(3):
        own = fitted[s, "m"]
        best = int(np.argmin(own.losses))
        assert len(own.trees) == best and len(own.losses) <= min(best + 4, 41) and len(own.losses) < 41
        check = np.array([i % 3 != s and i % 7 == 0 for i in range(len(y))])
        p = 1 / (1 + np.exp(-own.score(x[check], [0, 1, 2])))
        loss = -(w[check] * (y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p))).sum() / w[check].sum()
        assert loss == pytest.approx(min(own.losses), abs=1e-9)


def test_logistic_members_and_scores(spark):
    x, y, w = table(500)
    members = {"line": G.Logistic(("a", "c"), rounds=8), "tree": G.Boosted(("a", "b", "c"), rounds=3), "none": G.Boosted(("a",), rounds=0)}
    roles = roles_of(spark, len(y)).union(spark.createDataFrame([(9, i, "test") for i in range(4)], "split int, id long, role string"))
    got = {(r["split"], r["id"]): r for r in G.members_by_split(frame(spark, x, y, w), roles, members, "w").collect()}
    assert len(got) == len(y) + 4
    for s in range(3):
        train = np.array([i for i in range(len(y)) if i % 3 != s and i % 7 != 0])
        z = np.nan_to_num(x[:, [0, 2]])
        z = (z - z[train].mean(0)) / z[train].std(0)
        a = np.column_stack([np.ones(len(y)), z])
        beta = np.zeros(3)
        for _ in range(8):
            g = a[train].T @ (w[train] * (1 / (1 + np.exp(-a[train] @ beta)) - y[train]))
            g[1:] += beta[1:]
            beta -= 0.5 * g / len(train)
        for i in range(s, len(y), 3):
            assert got[s, i]["line"] == pytest.approx(1 / (1 + np.exp(-a[i] @ beta)), abs=1e-9)
    test = [r for r in got.values() if r["split"] < 3]
    loss = lambda c: -np.mean([math.log(r[c] if r["y"] else 1 - r[c]) for r in test])
    assert loss("tree") < loss("none") and loss("line") < loss("none")
    assert all(got[9, i][c] == 0.5 for i in range(4) for c in members)  # a split that trains nothing


def test_cuts_part_values_evenly(spark):
    rng = np.random.default_rng(0)
    n = 4000
    values = {"even": rng.random(n), "heavy": rng.exponential(size=n) ** 6, "few": rng.integers(0, 3, n).astype(float), "one": np.full(n, 7.0), "near": 1e6 + rng.random(n) * 1e-3 + (rng.random(n) < 0.001) * 1e9}
    df = spark.createDataFrame([tuple(float(v[i]) for v in values.values()) for i in range(n)], ", ".join(f"{k} double" for k in values))
    cuts = dict(zip(values, G.feature_cuts(df, list(values), bins=16)[0], strict=True))
    assert len(cuts["one"]) == 0 and len(cuts["few"]) == 2
    for k in ("even", "heavy", "near"):
        sizes = np.bincount(np.searchsorted(cuts[k], values[k], "left"), minlength=len(cuts[k]) + 1)
        assert len(cuts[k]) <= 15 and sizes.max() <= 2 * n / 16, (k, sizes)
    none = spark.createDataFrame([(None,)], "even double")
    assert [len(c) for c in G.feature_cuts(none, ["even"])[0]] == [0]
    assert df.select(F.count("*")).first()[0] == n
