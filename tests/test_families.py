"""Ensembles of all splits in the same passes against a loop that fits one split after the other."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from plumbline.operators import boosting as G
from plumbline.operators import evaluation as E
from plumbline.operators import models as M
from plumbline.operators import validation as V

FEATURES = ("a", "b", "c")
CONFIG = {"level": {"family": "level", "rounds": 3, "depth": 2, "rate": 0.4, "least_rows": 8}, "leaf": {"family": "leaf", "rounds": 2, "leaves": 4, "least_rows": 8}, "line": {"family": "logistic", "rounds": 6, "features": ("a", "c")}}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(12)
    n = 240
    x = rng.normal(size=(n, 3))
    fwd = 0.02 * x[:, 0] + 0.01 * (x[:, 1] > 0) + 0.02 * rng.normal(size=n)
    return {"id": np.arange(n), "start": np.arange(n), "stop": np.arange(n) + rng.integers(0, 6, n), "x": x, "fwd": fwd, "y": (fwd > 0).astype(int), "w": rng.choice([0.5, 1.0], n)}


@pytest.fixture(scope="module")
def rows(spark, data):
    out = [(int(i), int(data["start"][i]), int(data["stop"][i]), int(data["y"][i]), float(data["fwd"][i]), float(data["w"][i]), *map(float, data["x"][i])) for i in data["id"]]
    return spark.createDataFrame(out, "id long, start long, stop long, y int, fwd double, w double, a double, b double, c double").repartition(4)


def loop_split(spark, rows, roles, members):
    """id to members' scores of the training and tested rows of one split, fitted alone."""
    found = G.members_by_split(rows, spark.createDataFrame([(0, int(i), r) for i, r in roles], "split int, id long, role string"), members, "w", also=("train",))
    return {(r["role"], r["id"]): [r[m] for m in members] for r in found.collect()}


def blend(reference, scores):
    return np.mean([[(np.asarray(ref) <= s).mean() for s in col] for ref, col in zip(np.transpose(reference), np.transpose(scores), strict=True)], axis=0)


def isotonic(x, y, at):
    blocks = []
    for v in np.unique(x):
        blocks.append([y[x == v].sum(), (x == v).sum(), v, v])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b, a = blocks.pop(), blocks[-1]
            a[0], a[1], a[3] = a[0] + b[0], a[1] + b[1], b[3]
    return np.interp(at, [v for b in blocks for v in b[2:]], [b[0] / b[1] for b in blocks for _ in "xx"])


def purged_splits(data, groups, test, embargo):
    n = len(data["id"])
    blocks = np.array_split(np.arange(n), groups)
    for chosen in itertools.combinations(range(groups), test):
        tested = np.concatenate([blocks[g] for g in chosen])
        train = []
        for i in range(n):
            ok = i not in tested
            for g in chosen:
                a, z, last = data["start"][blocks[g]].min(), data["stop"][blocks[g]].max(), blocks[g][-1]
                ok &= bool(data["stop"][i] < a or (data["start"][i] > z and i > last + math.floor(n * embargo)))
            if ok:
                train.append(i)
        yield chosen, tested, np.array(train)


def test_paths_against_a_loop_over_splits(spark, rows, data):
    members = E.members_from(CONFIG, FEATURES)
    got = {(r["split"], r["id"]): r for r in E.ensemble_paths(rows, members, 4, 2, 0.02, 0.003, "w").collect()}
    seen = dict.fromkeys(range(4), 0)
    count = 0
    for split, (chosen, tested, train) in enumerate(purged_splits(data, 4, 2, 0.02)):
        s = loop_split(spark, rows, [(i, "test") for i in tested] + [(i, "train") for i in train], members)
        reference = np.array([s["train", i] for i in train])
        fit, new = blend(reference, reference), blend(reference, np.array([s["test", i] for i in tested]))
        p = isotonic(fit, data["y"][train], new)
        size = len(data["id"]) // 4
        for i, q in zip(tested, p, strict=True):
            r = got[split, i]
            assert r["position"] == pytest.approx(2 * q - 1, abs=1e-9)
            assert r["ret"] == pytest.approx((2 * q - 1) * data["fwd"][i] - abs(2 * q - 1) * 0.003, abs=1e-12)
            assert r["path"] == seen[i // size]
            count += 1
        for g in chosen:
            seen[g] += 1
    assert len(got) == count and seen == dict.fromkeys(range(4), 3)
    per = {}
    for r in got.values():
        per.setdefault(r["path"], []).append(r["ret"])
    assert {k: len(v) for k, v in per.items()} == dict.fromkeys(range(3), len(data["id"]))


def test_out_of_fold_ensembles_against_a_loop(spark, rows, data):
    members = E.members_from(CONFIG, FEATURES)
    folds = E.folds_of(rows, 3, 0.01)
    roles = {}
    for r in folds.collect():
        roles.setdefault(r["split"], []).append((r["id"], r["role"]))
    got = {r["id"]: r for r in E.out_of_fold_ensemble(rows, folds, members, "w").collect()}
    scores = {}
    for own in roles.values():
        found = loop_split(spark, rows, own, members)
        scores |= {i: v for (role, i), v in found.items() if role == "test"}
    ids = sorted(scores)
    all_ = np.array([scores[i] for i in ids])
    mixed = blend(all_, all_)
    p = isotonic(mixed, data["y"][ids], mixed)
    assert sorted(got) == ids == list(range(len(data["id"])))
    for k, i in enumerate(ids):
        assert [got[i][m] for m in members] == pytest.approx(scores[i], abs=1e-12)
        assert (got[i]["blend"], got[i]["p"]) == (pytest.approx(mixed[k], abs=1e-12), pytest.approx(p[k], abs=1e-9))
    frame = E.out_of_fold_ensemble(rows, folds, members, "w", "stack")
    quality = {r["member"]: r for r in E.member_quality(frame, [*members, "p"]).collect()}
    y = data["y"][ids]
    for j, m in enumerate(members):
        assert quality[m]["brier"] == pytest.approx(((all_[:, j] - y) ** 2).mean(), abs=1e-9)
        assert quality[m]["accuracy"] == pytest.approx(((all_[:, j] >= 0.5) == y).mean(), abs=1e-9)
    assert quality["p"]["log_loss"] < math.log(2)


def test_tuned_points_against_single_fits(spark, rows):
    points = {"slow": G.Boosted(FEATURES, rounds=2, rate=0.05, least_rows=8), "fast": G.Boosted(FEATURES, rounds=2, rate=0.8, least_rows=8), "line": G.Logistic(("a",), rounds=4)}
    folds = E.folds_of(rows, 3, 0.01)
    got = {r["point"]: r for r in E.tuned_members(rows, folds, points).collect()}
    alone = {k: E.tuned_members(rows, folds, {k: v}).first()["log_loss"] for k, v in points.items()}
    assert {k: r["log_loss"] for k, r in got.items()} == pytest.approx(alone, abs=1e-12)
    assert [k for k, r in got.items() if r["best"]] == [min(alone, key=alone.get)]


def test_mixtures_and_gates_of_groups(spark):
    rng = np.random.default_rng(8)
    made = []
    for g in range(3):
        for k in range(200):
            side = k % 2
            made.append((g, k, "train" if k < 150 else "test", float(rng.normal(side * 6 + g, 1)), float(rng.normal(-side, 1)), float((1 if side == g % 2 else -1) + 0.1 * rng.normal())))
    made.append((0, 999, "test", None, 1.0, 0.0))
    df = spark.createDataFrame(made, "split int, id int, role string, u double, v double, gain double")
    fits = {r["split"]: r for r in E.mixtures_by(df, ["u", "v"], 2, "split", 6).collect()}
    for g in range(3):
        one = M.diagonal_mixture(df.where(f"split = {g} and u is not null"), ["u", "v"], 2, 6)
        assert fits[g]["mean"] == pytest.approx(one["mean"].ravel().tolist(), abs=1e-9)
        assert fits[g]["var"] == pytest.approx(one["var"].ravel().tolist(), abs=1e-9) and fits[g]["weight"] == pytest.approx(one["weight"].tolist(), abs=1e-9)
    gates = {(r["split"], r["id"]): r["gate"] for r in E.gates_by(df, ["u", "v"], "gain", 2, "split", 6).collect()}
    assert gates[0, 999] == 1.0
    right = sum(gates[g, k] == float(k % 2 == g % 2) for g in range(3) for k in range(200))
    assert right > 590


def test_settings_and_path_statistics(spark, rows):
    with pytest.raises(ValueError, match="no family"):
        E.members_from({"x": {"family": "forest"}}, FEATURES)
    with pytest.raises(ValueError, match="needs a member"):
        E.members_from({}, FEATURES)
    out = E.ensemble_paths(rows, E.members_from({"line": CONFIG["line"]}, FEATURES), 4, 2, 0.02, regimes=(["b"], 2))
    d = V.path_distribution(out).first()
    assert d["paths"] == 3 and d["worst"] <= d["median"]
