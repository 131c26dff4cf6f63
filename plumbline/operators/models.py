"""Models fitted by aggregates over distributed rows; only parameters reach the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import numbered, summed
from ..sources.shared import written


def standardised(df: DataFrame, features: list[str]) -> DataFrame:
    """Features less their mean over their population deviation (0 where that is 0)."""
    row = df.agg(*(x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}")))).first()
    return df.withColumns({f: (F.col(f) - row[f"m_{f}"]) / row[f"s_{f}"] if row[f"s_{f}"] else F.lit(0.0) for f in features})


def fit_logistic(df: DataFrame, features: list[str], label: str = "y", l2: float = 1.0, rate: float = 0.5, rounds: int = 30) -> list[float]:
    """Intercept and weights by full-batch gradient descent; every round is one aggregate over the rows, which are kept
    (and recomputed where an executor is lost) from the first round on."""
    found = fit_logistic_by(df.withColumn("_g", F.lit(0)), features, "_g", label, l2, rate, rounds)
    return found.get(0, [0.0] * (len(features) + 1))


def fit_logistic_by(df: DataFrame, features: list[str], by: str, label: str = "y", l2: float = 1.0, rate: float = 0.5, rounds: int = 30) -> dict:
    """fit_logistic() of every group of by (a fold, say; some dozens at most) at once: a round is one aggregate by group."""
    kept = df.select(by, label, *features).persist()
    try:
        beta: dict = {}
        for _ in range(rounds):
            err = probability_by(features, by, beta) - F.col(label)
            sums = kept.groupBy(by).agg(F.count("*").alias("n"), F.sum(err).alias("g0"), *(F.sum(err * F.col(f)).alias(f"g{i + 1}") for i, f in enumerate(features)))
            after = {}
            for g in sums.collect():  # a row for each group
                own = beta.get(g[by], [0.0] * (len(features) + 1))
                after[g[by]] = [b - rate * (g[f"g{i}"] + (l2 * b if i else 0.0)) / g["n"] for i, b in enumerate(own)]
            beta = after
        return beta
    finally:
        kept.unpersist()


def probability_by(features: list[str], by: str, beta: dict) -> Column:
    """Each row's probability by its group's coefficients; one half for a group without any."""
    out = None
    for g, b in sorted(beta.items()):
        p = probability(features, b)
        out = F.when(F.col(by) == g, p) if out is None else out.when(F.col(by) == g, p)
    return F.lit(0.5) if out is None else out.otherwise(0.5)


def probability(features: list[str], beta: list[float]) -> Column:
    z = sum((F.col(f) * b for f, b in zip(features, beta[1:], strict=True)), F.lit(beta[0]))
    return 1 / (1 + F.exp(-z))


#: Blocks that one task pools at once.
POOLED = 1 << 16


def isotonic_blocks(df: DataFrame, x: str = "p", y: str = "y", weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by, lo, hi, value, w: the blocks of the non-decreasing weighted least-squares fit of y on x, of all rows or of each
    group; rows with a missing x or y are left out, and blocks of equal value are one. A written table.

    Equal scores are one value from the start. Blocks in order are dealt to runs of POOLED, each run pools its neighbours
    that violate the order, and runs shift by half until none do: pooling in any order ends the same."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    start = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("lo")).agg(F.sum(w * F.col(y)).alias("wy"), F.sum(w).alias("w"))
    blocks = start.where("w > 0").select(*by, "lo", F.col("lo").alias("hi"), "wy", "w")
    keys = [*by, "_run"]
    names = [*keys, "lo", "hi", "wy", "w"]
    shift = 0
    while True:
        placed = numbered(blocks, ["lo"], "_i", by)
        dealt = placed.withColumn("_run", F.expr(f"(_i + {shift}) div {POOLED}")).select(*names)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
        pooled = written(dealt.repartition(*keys).sortWithinPartitions(*keys, "lo").mapInArrow(_pool(len(keys)), kinds), "blocks")
        w_ = Window.partitionBy(*by).orderBy("_run")
        ends = pooled.groupBy(*keys).agg(F.min(F.struct("lo", (F.col("wy") / F.col("w")).alias("v")))["v"].alias("first"), F.max(F.struct("lo", (F.col("wy") / F.col("w")).alias("v")))["v"].alias("last"))
        if ends.withColumn("before", F.lag("last").over(w_)).where("before >= first").isEmpty():  # a row a run
            return pooled.select(*by, "lo", "hi", (F.col("wy") / F.col("w")).alias("value"), "w")
        blocks, shift = pooled.drop("_run"), POOLED // 2 - shift


def _pool(keys: int):
    """Pools neighbouring violators of every run of sorted rows: keys, lo, hi, wy, w."""
    import pyarrow as pa

    def run(batches):
        known, stack, schema = None, [], None

        def out() -> pa.RecordBatch:
            rows = [(*known, *b) for b in stack]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:keys] != known:
                    if stack:
                        yield out()
                    known, stack = row[:keys], []
                lo, hi, wy, w = row[keys:]
                while stack and stack[-1][2] * w >= wy * stack[-1][3]:
                    a = stack.pop()
                    lo, wy, w = a[0], a[2] + wy, a[3] + w
                stack.append((lo, hi, wy, w))
        if stack:
            yield out()

    return run


def calibrate(df: DataFrame, blocks: DataFrame, x: str = "p", name: str = "calibrated", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds name: the fit of isotonic_blocks() at x, linear between blocks and flat beyond; missing for a missing x and in a
    group without blocks. Blocks stay a table: scores and knots are sorted together, and each score meets its two."""
    ends = F.array_distinct(F.array(F.struct(F.col("lo").alias("kx"), F.col("value").alias("ky")), F.struct(F.col("hi").alias("kx"), F.col("value").alias("ky"))))
    knots = numbered(blocks.select(*by, F.explode(ends).alias("k")).select(*by, "k.kx", "k.ky"), ["kx", "ky"], "_at", by)
    after = knots.select(*by, (F.col("_at") - 1).alias("_at"), F.col("kx").alias("nx"), F.col("ky").alias("ny"))
    first = after.where("_at = -1").withColumns({"kx": F.col("nx"), "ky": F.col("ny")})
    spans = knots.join(after, [*by, "_at"], "left").unionByName(first)
    values = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("kx")).distinct().withColumn("_n", F.lit(0).cast("long"))
    both = knots.select(*by, "kx", F.lit(1).cast("long").alias("_n")).unionByName(values).groupBy(*by, "kx").agg(F.sum("_n").alias("_n"))
    ranked = summed(both, ["kx"], "_n", "_upto", by).select(*by, F.col("kx").alias("_x"), (F.col("_upto") - 1).alias("_at"))
    slope = F.try_divide(F.col("ny") - F.col("ky"), F.col("nx") - F.col("kx"))
    value = F.when((F.col("_x") <= F.col("kx")) | F.col("nx").isNull(), F.col("ky")).otherwise(F.col("ky") + slope * (F.col("_x") - F.col("kx")))
    found = ranked.join(spans, [*by, "_at"]).select(*by, "_x", value.alias(name))
    keyed = df.withColumn("_x", F.col(x).cast("double"))
    return keyed.join(found, [*by, "_x"], "left").select(*df.columns, name)


def rank_against(scores: DataFrame, reference: DataFrame, x: str = "p", by: tuple[str, ...] = (), name: str = "share", counted: str | None = None) -> DataFrame:
    """Adds name: the part of reference values (of the same group by) that are at most x. Both are sorted together by value
    counts; counted is a column of the reference that says how often a row counts (once if not given)."""
    reference = reference.withColumn("_k", F.col(counted).cast("long") if counted else F.lit(1).cast("long"))
    per = reference.groupBy(*by, x).agg(F.sum("_k").alias("n"))
    values = per.select(*by, x, "n").unionByName(scores.select(*by, x).distinct().withColumn("n", F.lit(0).cast("long"))).groupBy(*by, x).agg(F.sum("n").alias("n"))
    total = reference.where(F.col(x).isNotNull()).groupBy(*by).agg(F.sum("_k").alias("_all"))  # a row a group
    upto = summed(values, [x], "n", "_upto", by)
    ranked = upto.join(total, list(by)) if by else upto.join(F.broadcast(total))
    return scores.join(ranked.select(*by, x, F.try_divide("_upto", F.col("_all").cast("double")).alias(name)), [*by, x])


def diagonal_mixture(df: DataFrame, x: list[str], k: int, rounds: int = 10) -> dict:
    """Gaussian mixture with diagonal covariances by EM; components are sorted by their first mean.

    Each round sums responsibilities, values and squares in one aggregate of k * (2 * len(x) + 1) numbers."""
    df = df.select(*x).persist()
    stat = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x)), F.percentile(x[0], F.array(*(F.lit((j + 0.5) / k) for j in range(k)))).alias("q")).first()
    mean = np.array([[stat["q"][j], *(stat[f"m{i}"] for i in range(1, len(x)))] for j in range(k)])
    var = np.array([[max(stat[f"v{i}"], 1e-6) for i in range(len(x))]] * k)
    weight = np.full(k, 1 / k)
    for _ in range(rounds):
        r = responsibilities(x, mean, var, weight)
        sums = df.agg(
            *(F.sum(r[j]).alias(f"r{j}") for j in range(k)),
            *(F.sum(r[j] * F.col(c)).alias(f"s{j}_{i}") for j in range(k) for i, c in enumerate(x)),
            *(F.sum(r[j] * F.col(c) * F.col(c)).alias(f"q{j}_{i}") for j in range(k) for i, c in enumerate(x)),
        ).first()
        total = np.array([max(sums[f"r{j}"], 1e-9) for j in range(k)])
        mean = np.array([[sums[f"s{j}_{i}"] for i in range(len(x))] for j in range(k)]) / total[:, None]
        var = np.maximum(np.array([[sums[f"q{j}_{i}"] for i in range(len(x))] for j in range(k)]) / total[:, None] - mean**2, 1e-6)
        weight = total / total.sum()
    df.unpersist()
    by = np.argsort(mean[:, 0])
    return {"mean": mean[by], "var": var[by], "weight": weight[by]}


def responsibilities(x: list[str], mean: np.ndarray, var: np.ndarray, weight: np.ndarray) -> list[Column]:
    """Posterior of each component as columns."""
    logs = []
    for j in range(len(weight)):
        z = sum((F.pow(F.col(c) - float(mean[j, i]), 2) / float(var[j, i]) for i, c in enumerate(x)), F.lit(0.0))
        logs.append(F.lit(float(math.log(weight[j] + 1e-300) - 0.5 * np.log(2 * math.pi * var[j]).sum())) - z / 2)
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    parts = [F.exp(v - top) for v in logs]
    total = sum(parts, F.lit(0.0))
    return [p / total for p in parts]


def kmeans(df: DataFrame, k: int, vector: str = "embedding", seed: int = 1, rounds: int = 20) -> DataFrame:
    """Adds prediction by Lloyd's rounds of the machine-learning library."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_v").fit(ready).transform(ready).drop("_v")


def boosted_trees(df: DataFrame, features: list[str], label: str = "y", rounds: int = 10, seed: int = 1) -> DataFrame:
    """Adds p by gradient-boosted trees of the machine-learning library."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=features, outputCol="_f").transform(df)
    out = GBTClassifier(labelCol=label, featuresCol="_f", maxIter=rounds, maxDepth=3, seed=seed).fit(ready).transform(ready)
    return out.withColumn("p", vector_to_array("probability")[1]).drop("_f", "rawPrediction", "probability", "prediction")


def selection_score(clustered: DataFrame, vector: str = "embedding", key: str = "id", thesis: list[float] | None = None) -> DataFrame:
    """key, score: minus the distance to the centroid of the cluster whose centroid lies furthest along the thesis (equal
    weights if none is given; ties to the first cluster). clustered: key, vector, prediction. With fewer than two clusters
    the score is the row's own projection. Centroids are the only thing that is shared: one row for each cluster."""
    long = clustered.select("prediction", F.posexplode(vector).alias("at", "x"))
    centre = long.groupBy("prediction", "at").agg(F.avg("x").alias("c")).groupBy("prediction").agg(F.array_sort(F.collect_list(F.struct("at", "c"))).alias("s"))
    centre = centre.select("prediction", F.transform("s", lambda v: v["c"]).alias("c"))
    along = F.lit(None).cast("array<double>") if thesis is None else F.array(*(F.lit(float(v)) for v in thesis))

    def projection(c: Column) -> Column:
        weights = F.coalesce(along, F.transform(c, lambda v: F.lit(1.0) / F.size(c)))
        return F.aggregate(F.zip_with(c, weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    best = centre.withColumn("p", projection(F.col("c"))).agg(F.max_by("c", F.struct("p", -F.col("prediction"))).alias("_c"), F.count("*").alias("_k"))
    row = F.col(vector).cast("array<double>")
    far = F.sqrt(F.aggregate(F.zip_with(row, F.col("_c"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    return clustered.join(F.broadcast(best)).select(key, F.when(F.col("_k") < 2, projection(row)).otherwise(-far).alias("score"))
