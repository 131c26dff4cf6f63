"""Clustering around centroids with Drake's adaptive bounds.

Every vector keeps the numbers of several next nearest centroids with a lower bound of the distance to each, and one
remainder bound for all others. When centroids move, bounds shrink by what theirs moved, the remainder by the largest
move. A vector whose own distance is below all its bounds stays without another distance; else the centroids that the
bounds don't certify are measured, and if the remainder doesn't certify the rest, all of them. How many bounds a vector
keeps adapts: a quarter of the centroids at first, then as many as the last round needed, an eighth at least. Distances
are integers, so assignments and ties are exact; bounds are square roots, kept a little too low.

A round is one pass of numpy over Arrow batches of a written table, which holds vectors with their bounds. What reaches
the driver is one row a centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release, table

#: Vectors that are measured at once.
BLOCK = 2048
#: Integer components are below this, so that a squared distance over 2^12 components is a long.
LARGEST = 1 << 24
#: By what bounds are kept below the true distance, in proportion.
SLACK = 1e-9


class Centroids:
    """Centroids (k x d integers) and how far each has moved since the bounds were made."""

    def __init__(self, points: np.ndarray, moved: np.ndarray):
        self.points, self.moved = points, moved
        self.norms = (points * points).sum(1)
        self.limit = int(np.abs(points).max(initial=0))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances (rows of x by centroids)."""
        if not len(x):
            return np.zeros((0, len(self.points)), np.int64)
        largest = max(self.limit, int(np.abs(x).max()))
        if largest * largest * x.shape[1] < 1 << 51:  # every sum below is an integer that a double holds
            dots = (x.astype(np.float64) @ self.points.T.astype(np.float64)).astype(np.int64)
        else:
            dots = x @ self.points.T
        return (x * x).sum(1)[:, None] - 2 * dots + self.norms

    def distance(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows of x to one centroid each."""
        d = x - self.points[which]
        return (d * d).sum(1)


def _roots(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


def scan(x: np.ndarray, c: Centroids, bounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of every row (ties: the smaller number) with its squared distance, the numbers of the bounds
    next ones in order, and lower bounds of the distances to those and, in the last column, to all others."""
    d = c.distances(x)
    order = np.argsort(d, axis=1, kind="stable")
    low = np.full((len(x), bounds + 1), np.inf)
    ranked = _roots(np.take_along_axis(d, order[:, 1 : bounds + 2], 1))
    low[:, : ranked.shape[1]] = ranked
    own = order[:, 0]
    return own, d[np.arange(len(x)), own], order[:, 1 : bounds + 1].astype(np.int16), low


def narrowed(near: np.ndarray, low: np.ndarray, bounds: int) -> tuple[np.ndarray, np.ndarray]:
    """near and low with the first bounds centroids; the bounds of those that go are the remainder's from now on."""
    if near.shape[1] <= bounds:
        return near, low
    return near[:, :bounds], np.concatenate([low[:, :bounds], low[:, bounds:].min(1, keepdims=True)], 1)


def advance(x: np.ndarray, own: np.ndarray, near: np.ndarray, low: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same as scan() gives, from own, near and low as scan() or advance() gave them before the centroids moved; last
    how many of its near centroids a row was measured against, or the number of all centroids."""
    n, bounds = near.shape
    own, near, low = own.copy(), near.copy(), low.copy()
    low[:, :bounds] -= c.moved[near] * (1 + SLACK)
    low[:, bounds] -= c.moved.max(initial=0) * (1 + SLACK)
    best = c.distance(x, own)
    root = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    unsure = ~(root[:, None] < low[:, :bounds])
    measured = unsure.sum(1)
    row, slot = np.nonzero(unsure)
    if len(row):
        d = np.full((n, bounds + 1), np.iinfo(np.int64).max)
        d[:, bounds] = best
        d[row, slot] = c.distance(x[row], near[row, slot])
        low[row, slot] = _roots(d[row, slot])
        numbers = np.concatenate([near, own[:, None].astype(near.dtype)], 1)
        first = np.lexsort((numbers, d), axis=1)[:, 0]
        at = np.flatnonzero(first < bounds)  # the nearest one and the row's own change places
        low[at, first[at]] = _roots(best[at])
        near[at, first[at]] = own[at]
        own[at], best[at] = numbers[at, first[at]], d[at, first[at]]
        root[at] = np.sqrt(best[at].astype(np.float64)) * (1 + SLACK)
    at = np.flatnonzero(~(root < low[:, bounds]))
    if len(at):
        own[at], best[at], near[at], low[at] = scan(x[at], c, bounds)
        measured[at] = len(c.points)
    order = np.argsort(low[:, :bounds], axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    low[:, :bounds] = np.take_along_axis(low[:, :bounds], order, 1)
    return own, best, near, low, measured


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, components: int, scale: int) -> DataFrame:
    """vec_id, v: the integers floor(scale * x) of every vector with that many components, none null, NaN or infinite; other
    rows go. A component of LARGEST or more is an error, as its distances would not be longs."""
    v = F.col(vector_col)
    x = F.transform(v, lambda c: c.cast("double"))
    fine = (F.size(v) == components) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    kept = vectors.where(v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("_x"))
    small = F.forall("_x", lambda c: F.abs(c) < LARGEST / scale)
    whole = F.when(small, F.transform("_x", lambda c: F.floor(c * scale).cast("int")))
    return kept.select("vec_id", F.coalesce(whole, F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>")).alias("v"))


def _start(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose SHA-256 of salt and vec_id (null: "null") is smallest; of rows that share it, by components."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = rows.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


_STATE = "vec_id long, v array<int>, cluster int, distance long, near array<smallint>, low array<double>, measured int"


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(x).reshape(-1)))


def assign(state: DataFrame, c: Centroids, bounds: int) -> DataFrame:
    """state (vec_id, v, and after the first call cluster, near, low) with new clusters, distances and bounds; measured is
    the number of other centroids that a row was measured against, of all centroids in the first call and in a rescan."""
    first = "cluster" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = _matrix(b.column(1), np.int64)
                if first:
                    own, best, near, low = scan(x, c, bounds)
                    measured = np.full(len(x), len(c.points))
                else:
                    near, low = narrowed(_matrix(b.column(3), np.int16), _matrix(b.column(4), np.float64), bounds)
                    own, best, near, low, measured = advance(x, b.column(2).to_numpy().astype(np.int64), near, low, c)
                columns = [b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(best), _lists(near), _lists(low), pa.array(measured.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "cluster", "distance", "near", "low", "measured"])

    used = ["vec_id", "v"] if first else ["vec_id", "v", "cluster", "near", "low"]
    return state.select(*used).mapInArrow(run, _STATE)


def _sums(state: DataFrame, k: int, components: int) -> DataFrame:
    """cluster, n, needed, s0, s1, ...: rows, the most near centroids that one was measured against (0 if all rows were
    scanned) and componentwise sums of every cluster; one row a cluster from every batch, then one a cluster."""
    names = [f"s{j}" for j in range(components)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, own, measured = _matrix(b.column(1), np.int64), b.column(0).to_numpy(), b.column(2).to_numpy()
            order = np.argsort(own, kind="stable")
            which, at, n = np.unique(own[order], return_index=True, return_counts=True)
            needed = np.maximum.reduceat(np.where(measured < k, measured, 0)[order], at)
            sums = np.add.reduceat(x[order], at, axis=0)
            columns = [which.astype(np.int32), n, needed, *np.ascontiguousarray(sums.T)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "n", "needed", *names])

    kind = "cluster int, n long, needed int, " + ", ".join(f"{c} long" for c in names)
    part = state.select("cluster", "v", "measured").mapInArrow(run, kind)
    return part.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("needed").alias("needed"), *(F.sum(c).alias(c) for c in names))


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 64, scale: int = 256, salt: str = "2:"
) -> tuple[DataFrame, np.ndarray]:
    """A written table of vec_id, v, cluster, distance, near, low, measured for every vector of whole_vectors(), and the
    final centroids (k x components; fewer if there are fewer vectors).

    Centroids start as _start() says. Each round assigns every vector to the nearest centroid (squared Euclidean
    distance; ties: the smaller number), then replaces every centroid that has vectors by their componentwise
    floor(sum / count); then vectors are assigned once more. Rows that repeat an id count each, a null id passes.
    """
    rows = materialize(whole_vectors(vectors, id_col, vector_col, components, scale), "vectors")
    points = _start(rows, k, salt).reshape(-1, components)
    bounds, least = max(0, min(len(points) - 2, -(-k // 4))), k // 8
    state, c = rows, Centroids(points, np.zeros(len(points)))
    for turn in range(rounds + 1):
        after = materialize(assign(state, c, bounds), "assigned")
        release(state)
        state = after
        if turn < rounds:
            moved, needed = c.points.copy(), least
            for r in _sums(state, len(points), components).collect():  # a row a cluster
                which, n, most, *sums = r
                moved[which] = np.floor_divide(np.array(sums, np.int64), n)
                needed = max(needed, most)
            if turn:
                bounds = min(bounds, needed)
            step = moved - c.points
            c = Centroids(moved, np.sqrt((step * step).sum(1).astype(np.float64)))
    return state, c.points


def digests(points: np.ndarray) -> list[str]:
    """SHA-256 of every centroid's components as decimal integers, joined by commas."""
    return [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points.tolist()]


def _lookup(key: str, values: list, kind: T.DataType) -> Column:
    return F.get(F.lit(values).cast(T.ArrayType(kind)) if values else F.array().cast(T.ArrayType(kind)), F.col(key))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, points = cluster(table(spark, sf_dir, "embeddings"))
    each = dict(found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect())  # a row a cluster
    inertia = [each.get(i, 0) for i in range(len(points))]
    return found.select(
        "vec_id", "cluster", "distance",
        _lookup("cluster", inertia, T.LongType()).alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"),
        _lookup("cluster", digests(points), T.StringType()).alias("centroid_sha256"),
    )


_SQL_HEAD = """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), v) - 1 AS k, v AS c FROM kept
  QUALIFY k < 40)"""
_SQL_ROUND = """,
a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, min((d, k))[1]::BIGINT AS d, min((d, k))[2] AS k
  FROM (SELECT r, vec_id, v, k, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS d FROM kept, c{i})
  GROUP BY r, vec_id, v)"""
_SQL_MOVE = """,
c{j} AS MATERIALIZED (
  SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
    SELECT k, list(q ORDER BY j) AS m FROM (
      SELECT k, j, floor(sum(v[j]) / count(*)) AS q FROM a{i}, range(1, 65) t(j) GROUP BY k, j) GROUP BY k) USING (k))"""
ORACLE_SQL = (
    _SQL_HEAD
    + "".join(_SQL_ROUND.format(i=i) + (_SQL_MOVE.format(i=i, j=i + 1) if i < 5 else "") for i in range(6))
    + """
SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a5 JOIN c5 USING (k)
"""
)
