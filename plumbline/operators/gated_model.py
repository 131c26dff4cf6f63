"""A trained ensemble with its calibration and gate, as a transformer that is saved, verified and loaded."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import filesystem, written
from . import boosting as G
from . import evaluation as E
from . import models as M


class DigestError(ValueError):
    """A saved model's files are not those that were written."""


class GatedEnsemble(Transformer):
    """Adds the members' probabilities, blend, p, gate and position to rows with the features and the gate's columns.

    members: fitted models by name over features; reference: member, value, n, the scores that blends are ranked against;
    blocks: M.isotonic_blocks() of the blend; gate: columns, mean, var, weight (as E.mixtures_by() has them) and a
    multiplier for each regime, or None. position is 2 p - 1 times the gate."""

    def __init__(self, features: list[str], members: dict[str, G.Fitted], reference: DataFrame, blocks: DataFrame, gate: dict | None = None, tags: dict | None = None):
        super().__init__()
        self.features, self.members, self.reference, self.blocks, self.gate, self.tags = features, members, reference, blocks, gate, tags or {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key = "_row"
        held = written(dataset.withColumn(key, F.monotonically_increasing_id()), "input")
        x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in self.features)).alias("x")
        rows = held.select(F.col(key).alias("id"), F.lit(0.0).alias("y"), x, F.array(F.lit(0)).alias("test"))
        s = G.scores(rows, self.features, {(0, n): f for n, f in self.members.items()}).drop("split", "role", "y")
        for m in self.members:
            s = M.rank_against(s, self.reference.where(F.col("member") == m).withColumnRenamed("value", m), m, (), f"_{m}", "n")
        blend = sum((F.col(f"_{m}") for m in self.members), F.lit(0.0)) / len(self.members)
        s = M.calibrate(s.withColumn("blend", blend).drop(*(f"_{m}" for m in self.members)), self.blocks, "blend", "p")
        out = held.join(s.withColumnRenamed("id", key), key).drop(key)
        return out.withColumn("gate", self._gate()).withColumn("position", (2 * F.col("p") - 1) * F.col("gate"))

    def _gate(self):
        g = self.gate
        if g is None:
            return F.lit(1.0)
        k = len(g["weight"])
        r = M.responsibilities(g["columns"], *(np.array(g[c]).reshape(k, -1) for c in ("mean", "var")), np.array(g["weight"]))
        top = F.greatest(*r) if k > 1 else r[0]
        return F.coalesce(*(F.when(p == top, float(m)) for p, m in zip(r, g["multipliers"], strict=True)), F.lit(1.0))

    # --- files

    def save(self, path: str) -> None:
        """Writes the model below path, which must not exist, and last the digests of its files: without them it isn't one."""
        spark = self.reference.sparkSession
        fs, at = filesystem(spark, path)
        if fs.exists(at):
            raise FileExistsError(path)
        self.reference.write.parquet(f"{path}/reference")
        self.blocks.write.parquet(f"{path}/blocks")
        _put(spark, f"{path}/model.json", {"features": self.features, "members": {n: _plain(f) for n, f in self.members.items()}, "gate": self.gate, "tags": self.tags})
        _put(spark, f"{path}/digests.json", digests(spark, path))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GatedEnsemble:
        """The model below path; DigestError if a file is missing, added or has other bytes than were written."""
        known = _get(spark, f"{path}/digests.json")
        found = digests(spark, path)
        if known != found:
            odd = sorted(k for k in known.keys() | found.keys() if known.get(k) != found.get(k))
            raise DigestError(f"{path}: {', '.join(odd[:5])} differ from what was saved")
        m = _get(spark, f"{path}/model.json")
        reference = spark.read.schema("member string, value double, n long").parquet(f"{path}/reference")
        blocks = spark.read.schema("lo double, hi double, value double, w double").parquet(f"{path}/blocks")
        return cls(m["features"], {n: _fitted(f) for n, f in m["members"].items()}, reference, blocks, m["gate"], m["tags"])


def digests(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of every data file below path by its name there; tasks read the files, the names reach the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fs, at = filesystem(spark, path)
    root = fs.makeQualified(at).toUri().getPath()
    rows = files.select(F.col("path"), F.sha2("content", 256).alias("digest")).collect()
    named = {r["path"].split(root, 1)[1].lstrip("/"): r["digest"] for r in rows}
    return {k: v for k, v in sorted(named.items()) if k != "digests.json"}


def _put(spark: SparkSession, path: str, value: dict) -> None:
    fs, at = filesystem(spark, path)
    out = fs.create(at, False)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> dict:
    fs, at = filesystem(spark, path)
    if not fs.exists(at):
        raise DigestError(f"{path} is missing")
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return json.loads(bytes(row["content"]).decode())


def _plain(f: G.Fitted) -> dict:
    kind = "logistic" if isinstance(f.member, G.Logistic) else "boosted"
    arrays = {c: None if getattr(f, c) is None else getattr(f, c).tolist() for c in ("mean", "scale", "weights")}
    return {"kind": kind, "member": asdict(f.member), "cuts": [c.tolist() for c in f.cuts], "start": f.start, "trees": [asdict(t) for t in f.trees], **arrays}


def _fitted(d: dict) -> G.Fitted:
    own = {k: tuple(v) if k == "features" else v for k, v in d["member"].items()}
    member = G.Logistic(**own) if d["kind"] == "logistic" else G.Boosted(**own)
    arrays = {c: None if d[c] is None else np.array(d[c]) for c in ("mean", "scale", "weights")}
    return G.Fitted(member, [np.array(c, float) for c in d["cuts"]], d["start"], [G.Tree(**t) for t in d["trees"]], **arrays)


def train_final(rows: DataFrame, roles: DataFrame, members: E.Members, weight: str | None = None, regimes: tuple[list[str], int] | None = None, cost: float = 0.0, tags: dict | None = None) -> GatedEnsemble:
    """The model to keep: blend and calibration fitted on the scores out of fold (roles: split, id, role), members fitted on
    all rows (id, y, features, weight, and with regimes their columns and fwd), regimes on all rows, and a regime's gate 1
    where its rows' positions out of fold earn more than cost times their size, else 0."""
    features = list(dict.fromkeys(f for m in members.values() for f in m.features))
    names = list(members)
    oof = E.out_of_fold_ensemble(rows, roles, members, weight)
    reference = None
    for m in names:
        one = oof.groupBy(F.lit(m).alias("member"), F.col(m).alias("value")).agg(F.count("*").alias("n"))
        reference = one if reference is None else reference.unionByName(one)
    blocks = M.isotonic_blocks(oof, "blend")
    ready = G.prepared(rows, features, rows.select(F.lit(0).alias("split"), "id", F.lit("train").alias("role")), weight)
    fitted = {n: f for (_, n), f in G.fit(ready, features, members).items()}
    gate = None
    if regimes:
        columns, k = regimes
        fit = E.mixtures_by(rows.withColumn("_g", F.lit(0)), columns, k, "_g").first()
        found = {"columns": columns, "mean": list(fit["mean"]), "var": list(fit["var"]), "weight": list(fit["weight"])}
        r = M.responsibilities(columns, *(np.array(found[c]).reshape(k, -1) for c in ("mean", "var")), np.array(found["weight"]))
        top = F.greatest(*r) if k > 1 else r[0]
        position = 2 * F.col("p") - 1
        gain = position * F.col("fwd") - F.abs(position) * cost
        sums = oof.select("id", "p").join(rows, "id").agg(*(F.avg(F.when(q == top, gain)).alias(f"g{j}") for j, q in enumerate(r))).first()
        gate = found | {"multipliers": [1.0 if (sums[f"g{j}"] or 0.0) > 0 else 0.0 for j in range(k)]}
    return GatedEnsemble(features, fitted, written(reference, "reference"), blocks, gate, tags)


def round_trip(model: GatedEnsemble, path: str, sample: DataFrame, key: str = "id") -> tuple[GatedEnsemble, float]:
    """Saves the model, loads it again, and the largest difference between both models' positions on sample."""
    model.save(path)
    again = GatedEnsemble.load(sample.sparkSession, path)
    a, b = model.transform(sample), again.transform(sample).select(key, F.col("position").alias("_again"))
    worst = a.join(b, key).agg(F.max(F.abs(F.col("position") - F.col("_again")))).first()[0]
    return again, float(worst or 0.0)
