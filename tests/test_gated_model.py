"""A saved ensemble gives the same positions when it is loaded, and refuses files that changed."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import evaluation as E
from plumbline.operators.gated_model import DigestError, GatedEnsemble, round_trip, train_final

CONFIG = {"level": {"family": "level", "rounds": 2, "depth": 2, "least_rows": 8}, "line": {"family": "logistic", "rounds": 4, "features": ("a", "b")}}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    n = 200
    x = rng.normal(size=(n, 3))
    fwd = 0.02 * x[:, 0] * np.sign(x[:, 2]) + 0.005 * rng.normal(size=n)
    out = [(i, i, i + 2, int(fwd[i] > 0), float(fwd[i]), *map(float, x[i])) for i in range(n)]
    rows = spark.createDataFrame(out, "id long, start long, stop long, y int, fwd double, a double, b double, c double").repartition(3)
    model = train_final(rows, E.folds_of(rows, 3, 0.01), E.members_from(CONFIG, ("a", "b", "c")), regimes=(["c"], 2), cost=0.0001, tags={"model_version": "7"})
    path = str(tmp_path_factory.mktemp("m") / "model")
    loaded, worst = round_trip(model, path, rows)
    return rows, model, loaded, worst, path


def test_loaded_positions_do_not_differ(spark, made):
    rows, model, loaded, worst, path = made
    assert worst == 0.0 and loaded.tags == {"model_version": "7"} and loaded.features == model.features
    new = spark.createDataFrame([(1000, 0.3, -2.0, 0.4), (1001, None, 0.1, None), (1000, 0.3, -2.0, 0.4)], "id long, a double, b double, c double")
    a, b = ([tuple(r) for r in m.transform(new).orderBy("id").collect()] for m in (model, loaded))
    assert a == b and len(a) == 3
    got = loaded.transform(new).where("id = 1001").first()
    assert got["gate"] == 1.0 and got["position"] == pytest.approx(2 * got["p"] - 1)  # no regime: not gated
    assert {r["gate"] for r in loaded.transform(rows).collect()} <= {0.0, 1.0}
    with pytest.raises(FileExistsError):
        model.save(path)


def test_blend_and_calibration_are_those_out_of_fold(spark, made):
    rows, model, *_ = made
    oof = E.out_of_fold_ensemble(rows, E.folds_of(rows, 3, 0.01), E.members_from(CONFIG, ("a", "b", "c"))).toPandas()
    got = model.transform(rows).toPandas()
    want = np.mean([[(oof[m].to_numpy() <= v).mean() for v in got[m]] for m in CONFIG], axis=0)
    assert got["blend"].to_numpy() == pytest.approx(want, abs=1e-12)
    blocks = model.blocks.orderBy("lo").toPandas()
    knots = np.interp(want, blocks[["lo", "hi"]].to_numpy().ravel(), np.repeat(blocks["value"].to_numpy(), 2))
    assert got["p"].to_numpy() == pytest.approx(knots, abs=1e-9)


@pytest.mark.parametrize("change", ["byte", "gone", "added", "digests"])
def test_changed_files_are_refused(spark, made, tmp_path, change):
    import shutil

    path = tmp_path / "copy"
    shutil.copytree(made[4], path)
    assert GatedEnsemble.load(spark, str(path)).features == ["a", "b", "c"]
    for crc in path.rglob(".*.crc"):
        crc.unlink()
    block = next((path / "blocks").glob("*.parquet"))
    if change == "byte":
        m = json.loads((path / "model.json").read_text())
        m["members"]["line"]["weights"][0] += 1e-9
        (path / "model.json").write_text(json.dumps(m, sort_keys=True))
    elif change == "gone":
        block.unlink()
    elif change == "added":
        shutil.copy(block, block.with_name("more.parquet"))
    else:
        (path / "digests.json").unlink()
    with pytest.raises(DigestError):
        GatedEnsemble.load(spark, str(path))


def test_gate_multipliers_follow_what_was_earned(spark, made):
    rows, model, *_ = made
    g = model.gate
    assert len(g["multipliers"]) == 2 and sum(g["weight"]) == pytest.approx(1)
    gates = model.transform(rows).groupBy("gate").agg(F.avg("c").alias("c")).collect()
    if len(gates) == 2:
        by = {r["gate"]: r["c"] for r in gates}
        low = g["mean"].index(min(g["mean"]))
        assert (by[1.0] < by[0.0]) == (g["multipliers"][low] == 1.0)
