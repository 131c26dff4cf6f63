"""Queries of fitted models against the same fits in numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import cross_section as C
from plumbline.plans.registry import QUERIES
from plumbline.sources import views

from .test_research import descend, folds_of


def test_mixture_of_events_against_numpy(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", "value").toPandas().sort_values("event_id")
    x = np.column_stack([np.log(e["value"].to_numpy()), (e["event_id"] % 10).to_numpy(float)])
    mean = np.array([[np.quantile(x[:, 0], q), x[:, 1].mean()] for q in (0.25, 0.75)])
    var, weight = np.array([x.var(0)] * 2), np.array([0.5, 0.5])

    def posterior():
        logs = np.log(weight) - 0.5 * np.log(2 * np.pi * var).sum(1) - ((x[:, None] - mean) ** 2 / var).sum(2) / 2
        p = np.exp(logs - logs.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    for _ in range(5):
        r = posterior()
        total = r.sum(0)
        mean = r.T @ x / total[:, None]
        var = np.maximum(r.T @ x**2 / total[:, None] - mean**2, 1e-6)
        weight = total / total.sum()
    order = np.argsort(mean[:, 0])
    mean, var, weight = mean[order], var[order], weight[order]
    want = dict(zip(e["event_id"], posterior(), strict=True))
    got = QUERIES["m08_regime_mixture"](spark, sf).collect()
    assert len(got) == len(want)
    assert all([r["p0"], r["p1"]] == pytest.approx(want[r["event_id"]].tolist(), abs=1e-6) for r in got)


def test_clusters_are_settled_or_nearly(spark, sf):
    """Lloyd's rounds leave vectors nearest to the mean of their own cluster."""
    e = {r["vec_id"]: np.array(r["embedding"], float) for r in views.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()}
    got = {r["vec_id"]: r["cluster"] for r in QUERIES["m10_kmeans"](spark, sf).collect()}
    assert got.keys() == e.keys() and set(got.values()) == set(range(5))
    x, c = np.array([e[k] for k in sorted(e)]), np.array([got[k] for k in sorted(e)])
    centres = np.array([x[c == k].mean(0) for k in range(5)])
    nearest = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
    assert (nearest == c).mean() > 0.97
    within = ((x - centres[c]) ** 2).sum()
    assert within < 0.999 * ((x - x.mean(0)) ** 2).sum()


def scored_rows(spark, sf):
    s = views.scores(spark, sf).toPandas().sort_values("id")
    x = np.column_stack([s["p"], s["id"] % 7]).astype(float)
    return (x - x.mean(0)) / x.std(0), s["y"].to_numpy(float)


def out_of_fold(x, y, rounds):
    p = np.full(len(y), np.nan)
    fold = np.full(len(y), -1)
    for k, (block, train) in enumerate(folds_of(len(y), 5, 3, 0.01)):
        beta = descend(x[train], y[train], rounds)
        p[block] = 1 / (1 + np.exp(-(beta[0] + x[block] @ beta[1:])))
        fold[block] = k
    return p, fold


def test_summaries_of_folds_against_numpy(spark, sf):
    x, y = scored_rows(spark, sf)
    p, fold = out_of_fold(x, y, 10)
    got = {r["fold"]: r for r in QUERIES["m06_summary"](spark, sf).collect()}
    assert got.keys() == set(fold)
    for k, r in got.items():
        q, t = p[fold == k], y[fold == k]
        assert r["n"] == len(t) and r["brier"] == pytest.approx(((q - t) ** 2).mean(), abs=1e-9)
        assert r["log_loss"] == pytest.approx(-(t * np.log(q) + (1 - t) * np.log(1 - q)).mean(), abs=1e-9)
        assert r["accuracy"] == pytest.approx(((q >= 0.5) == t).mean(), abs=1e-9)


def test_stacks_against_numpy(spark, sf):
    x, y = scored_rows(spark, sf)
    members = np.column_stack([out_of_fold(x[:, [j]], y, 10)[0] for j in (0, 1)])
    z = (members - members.mean(0)) / members.std(0)
    beta = descend(z, y, 10)
    want = 1 / (1 + np.exp(-(beta[0] + z @ beta[1:])))
    got = QUERIES["m04_stacked"](spark, sf).orderBy("id").collect()
    assert [r["p"] for r in got] == pytest.approx(want.tolist(), abs=2e-6)


def test_date_folds_against_numpy(spark, sf):
    w = C.dated()
    p = views.panel(spark, sf).withColumns({"mom": C.momentum(20, 0), "fwd": F.try_divide(F.lead("close", 5).over(w), "close") - 1, "last": F.lead("date", 5).over(w)})
    p = p.where("mom is not null and fwd is not null").select("date", "symbol", "mom", "fwd", "last").toPandas().sort_values(["date", "symbol"])
    p["y"] = (p["fwd"] >= p.groupby("date")["fwd"].transform("median")).astype(float)
    z = (p["mom"] - p["mom"].mean()) / p["mom"].std(ddof=0)
    days = p.groupby("date")["last"].max()
    n = len(days)
    want = {}
    for k, block in enumerate(np.array_split(np.arange(n), 4)):
        a, stop, last = days.index[block[0]], days.iloc[block].max(), block[-1]
        train = [d for i, d in enumerate(days.index) if days.iloc[i] < a or (d > stop and i > last + int(n * 0.01))]
        inside = p["date"].isin(train).to_numpy()
        beta = descend(z[inside].to_numpy()[:, None], p["y"][inside].to_numpy(), 5)
        tested = p["date"].isin(days.index[block]).to_numpy()
        for r, v in zip(p[tested].itertuples(), z[tested], strict=True):
            want[f"{r.date}|{r.symbol}"] = (k, 1 / (1 + np.exp(-(beta[0] + beta[1] * v))))
    got = QUERIES["m13_date_folds"](spark, sf).collect()
    assert len(got) == len(want)
    assert all(r["fold"] == want[r["id"]][0] and r["p"] == pytest.approx(want[r["id"]][1], abs=2e-6) for r in got)
