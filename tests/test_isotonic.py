"""Isotonic fits in runs against plain pooling, and scores calibrated by a table of knots."""

from __future__ import annotations

import numpy as np
import pytest

from plumbline.operators import models as M


def pool(x, y, w):
    """Knots of weighted pooling of adjacent violators, equal scores first."""
    blocks = []
    for v in np.unique(x):
        at = x == v
        blocks.append([(w[at] * y[at]).sum(), w[at].sum(), v, v])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b, a = blocks.pop(), blocks[-1]
            a[0], a[1], a[3] = a[0] + b[0], a[1] + b[1], b[3]
    return [(lo, hi, s / n) for s, n, lo, hi in blocks]


@pytest.mark.parametrize("pooled", [1 << 16, 8])
def test_fits_of_groups_against_pooling(spark, monkeypatch, pooled):
    monkeypatch.setattr(M, "POOLED", pooled)
    rng = np.random.default_rng(6)
    n = 300
    groups = {
        "noise": (rng.random(n), rng.random(n)),
        "ties": (rng.integers(0, 12, n) / 12, rng.integers(0, 2, n).astype(float)),
        "falling": (np.arange(n) / n, 1 - np.arange(n) / n),
        "rising": (np.arange(n) / n, (np.arange(n) / n) ** 2),
        "flat": (np.arange(n) / n, np.full(n, 0.5)),
        "late": (np.arange(n) / n, np.r_[np.arange(n - 1) / n, -50.0]),
        "one": (np.array([0.25]), np.array([1.0])),
    }
    rows, weights = [], {}
    for g, (x, y) in groups.items():
        weights[g] = rng.integers(1, 9, len(x)) / 4
        rows += [(g, float(a), float(b), float(c)) for a, b, c in zip(x, y, weights[g], strict=True)]
    rows += [("noise", None, 0.5, 1.0), ("noise", 0.5, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, p double, y double, w double").repartition(5)
    blocks = M.isotonic_blocks(df, weight="w", by=("g",))
    probe = spark.createDataFrame([(g, float(v)) for g in groups for v in [-1, 0, 0.1234, 0.5, 0.77777, 1, 2]] + [("other", 0.5), ("noise", None)], "g string, p double")
    fit = {(r["g"], r["p"]): r["calibrated"] for r in M.calibrate(probe, blocks, by=("g",)).collect()}
    for g, (x, y) in groups.items():
        want = pool(x, y, weights[g])
        got = sorted((r["lo"], r["hi"], r["value"]) for r in blocks.where(blocks.g == g).collect())
        assert [r[:2] for r in got] == [r[:2] for r in want], g
        assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-9)
        kx, ky = [v for lo, hi, _ in want for v in (lo, hi)], [v for _, _, s in want for v in (s, s)]
        for v in [-1, 0, 0.1234, 0.5, 0.77777, 1, 2]:
            assert fit[g, float(v)] == pytest.approx(np.interp(v, kx, ky), abs=1e-9), (g, v)
    assert fit["other", 0.5] is None and fit["noise", None] is None


def test_ungrouped_and_empty(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 1), (0.6, 0), (0.8, 1)], "p double, y int")
    assert [tuple(r) for r in M.isotonic_blocks(df).orderBy("lo").collect()] == [(0.2, 0.2, 0.0, 1.0), (0.4, 0.6, 0.5, 2.0), (0.8, 0.8, 1.0, 1.0)]
    none = M.isotonic_blocks(df.limit(0))
    assert none.count() == 0 and [r["calibrated"] for r in M.calibrate(df, none).collect()] == [None] * 4
