"""Repeated passages, Merkle proofs and centroid clusters against plain loops, on nulls, ties, repeats and long rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import op11_passages, op12_merkle, op13_drake, registry
from plumbline.llm.filters import key_filter, may_hold

from ..compare import connect, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: names that operators might give to columns of their own
CLASHES = ["uid", "doc", "spans", "key", "shard", "g", "h", "i", "m", "path", "task", "place", "_row", "cluster", "v", "low", "near"]


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_repeated_passages", "op12_merkle_manifest", "op13_drake_clusters"])
def test_against_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), connect(sf), registry.ORACLE_SQL[name])


def loop_kept(rows: list[tuple]) -> list[tuple]:
    """id, kept words by the definition: rows that share an id are one document, a null id is one of its own."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first: dict[tuple, tuple] = {}
    for i, w in words:
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if i is not None:
                first[k] = min(first.get(k, (i, a)), (i, a))
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if (i is None and (k in first or k in [tuple(w[b : b + 20]) for b in range(a)])) or (i is not None and first[k] < (i, a)):
                gone.update(range(a, a + 20))
        out.append((i, " ".join(x for n, x in enumerate(w) if n not in gone)))
    return out


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(11)
    word = lambda: rng.choice(["alpha", "béta", "gamma", "delta", "x"]) + str(rng.randrange(40))
    prose = lambda n: [word() for _ in range(n)]
    shared = [prose(n) for n in (19, 20, 21, 31, 60, 300)]
    rows = []
    for i in range(60):
        w = prose(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, max(0, len(p) - 20))
            at = rng.randint(0, len(w))
            w[at:at] = p[a : a + rng.randint(15, 90)]
        rows.append((i * 7 % 61, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [rows[0], rows[0], (100, None), (101, ""), (102, " \n "), (103, "la " * 3000), (104, "la la " * 9), (105, "la " * 25), (106, "a b c " * 500), (107, "b c a " * 8)]
    rows += [(110, " ".join(shared[4])), (110, "so " + " ".join(shared[4])), (None, "now " + " ".join(shared[5])), (None, None), (200, " ".join(prose(30_000) + shared[3]))]
    return rows


def test_passages_against_a_loop(spark, passages):
    docs = spark.createDataFrame(passages, "doc_id long, text string").withColumns({c: F.lit("own") for c in CLASHES}).repartition(5)
    found = op11_passages.repeated_passages(docs).collect()
    got = Counter((r["doc_id"], b" ".join(op11_passages._kept(r["text"], r["spans"])[2]).decode()) for r in found)
    assert got == Counter(loop_kept(passages))
    assert sum(bool(r["spans"]) for r in found) > 20
    texts = Counter(op11_passages.clean(docs).select("doc_id", "text").collect())
    lost = {(r["doc_id"], r["text"]) for r in found if r["spans"]}
    whole = [tuple(r) for r in passages if tuple(r) not in lost]
    assert all(texts[w] for w in whole)
    assert op11_passages.repeated_passages(docs.limit(0)).count() == 0


def test_passages_of_many_shards_and_tasks(spark, passages, monkeypatch):
    """The same result where every shard is small, an anchor has many shards, and a shard's text many tasks."""
    monkeypatch.setattr(op11_passages, "SHARD_WINDOWS", 40)
    monkeypatch.setattr(op11_passages, "TASK_BYTES", 2000)
    monkeypatch.setattr(op11_passages, "COMPARED", 7)
    docs = spark.createDataFrame(passages, "doc_id long, text string")
    found = op11_passages.repeated_passages(docs).collect()
    got = Counter((r["doc_id"], b" ".join(op11_passages._kept(r["text"], r["spans"])[2]).decode()) for r in found)
    assert got == Counter(loop_kept(passages))


def test_filters_never_miss_a_key(spark):
    keys = [random.Random(3).randrange(-(1 << 63), 1 << 63) for _ in range(5000)]
    held = key_filter(spark.createDataFrame([(k,) for k in keys], "key long"), len(keys))
    assert may_hold(held, np.array(keys)).all()
    other = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 50_000)
    assert may_hold(held, other).mean() < 0.03
    none = key_filter(spark.createDataFrame([], "key long"), 0)
    assert not may_hold(none, other).any()


def loop_proofs(rows: list[tuple]) -> Counter:
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    leaf = lambda r, t: sha(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(t))

    def levels(h):
        out = [h]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    groups = []
    for lang in sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        groups.append((mine, levels([leaf(r, r[1]) for r in mine])))
    top = levels([lv[-1][0] for _, lv in groups])
    out = []
    for n, (mine, lv) in enumerate(groups):
        for k, r in enumerate(mine):
            proof = ""
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf(r, lower(r[1]) if hit else r[1])
            for tree, at in ((lv, k), (top, n)):
                for level in tree[:-1]:
                    run = level[at // 8 * 8 :][:8]
                    proof += "".join(run[: at % 8] + run[at % 8 + 1 :])
                    folded = sha(*run[: at % 8], folded, *run[at % 8 + 1 :])
                    at //= 8
            out.append((r[0], leaf(r, r[1]), lv[-1][0], top[-1][0], sha(proof), folded, folded == top[-1][0]))
    return Counter(out)


def manifest_rows(n: int) -> list[tuple]:
    rng = random.Random(n)
    langs = ["en", "en", "en", "fr", "é", None, "", "zz"] if n > 9 else ["en"]
    return [(i, rng.choice([None, "", "Text ÀB", "x" * 40_000 if i == 5 else "plain", "One\nTwo"]), rng.choice(langs), rng.choice(["s", None]), rng.choice([4, None])) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 8, 9, 700])
def test_proofs_against_a_loop(spark, n):
    rows = manifest_rows(n)
    if n > 9:
        rows += [rows[3], rows[3], (None, "No Id", "en", "s", 1), (None, "No Id", "en", "s", 1), (None, None, None, None, None), (9000, "Lone", "only", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("own") for c in CLASHES}).repartition(6)
    found = op12_merkle.document_proofs(docs)
    found = found.withColumns({"p": F.sha2(op12_merkle.siblings(F.col("path")), 256), "f": op12_merkle.fold(F.col("path"), F.col("changed_leaf"))})
    got = Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["p"], r["f"], r["f"] == r["root"]) for r in found.collect())
    want = loop_proofs(rows)
    assert got == want
    if n == 700:
        assert 50 < sum(v for k, v in want.items() if not k[-1]) < 600


def test_numbers_of_a_repeated_row(spark):
    """Rows that are equal throughout have numbers of their own, and a group is numbered without gaps."""
    rows = spark.range(5000).select(F.lit("=a").alias("g"), F.lit(7).alias("x"), F.col("id").alias("_row"))
    got = op12_merkle.numbered(rows.repartition(4), ["x", "_row"]).select("i", "m").collect()
    assert sorted(r["i"] for r in got) == list(range(5000)) and {r["m"] for r in got} == {5000}


def loop_clusters(rows: list[tuple], k: int, rounds: int) -> tuple[list[tuple], list[list[int]]]:
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (sha("2:", "null" if r[0] is None else str(r[0])), r[1]))
    points = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), n) for n, p in enumerate(points))
    for _ in range(rounds):
        by: dict[int, list] = {}
        for _, v in kept:
            by.setdefault(nearest(v)[1], []).append(v)
        points = [[sum(c) // len(c) for c in zip(*by[n], strict=True)] if n in by else p for n, p in enumerate(points)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], points


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_clusters_against_a_loop(spark, spread):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 64))
    x = np.float32(centers[rng.integers(0, 12, 260)] + spread * rng.normal(size=(260, 64)))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [rows[0]] * 30 + [(900 + i, rows[1][1]) for i in range(30)] + [(None, rows[2][1]), (None, rows[3][1])]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [None] + [1.0] * 63), (1004, [float("nan")] + [1.0] * 63), (1005, [float("inf")] * 64), (1006, [0.0] * 64), (1007, [-0.001] * 64)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("own") for c in CLASHES}).repartition(5)
    for k in (40, 7, 1):
        found, points = op13_drake.cluster(vectors, k)
        want, centroids = loop_clusters(rows, k, 5)
        assert points.tolist() == centroids
        assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()) == Counter(want)
        if k == 40:
            spared = found.where("measured < 40").count()
            assert spared > len(want) // 4  # the bounds do spare work


def test_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    found, points = op13_drake.cluster(spark.createDataFrame([], kind))
    assert found.count() == 0 and points.shape == (0, 64)
    found, points = op13_drake.cluster(spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], kind))
    assert {(r["vec_id"], r["distance"]) for r in found.collect()} == {(1, 0), (2, 0)} and len(points) == 2
    with pytest.raises(Exception, match="too large"):
        op13_drake.cluster(spark.createDataFrame([(1, [1e30] * 64)], kind))[0].count()


def test_bounds_stay_below_the_distances():
    """Along moves of every size, assignments equal those of a whole scan and no bound is above what it bounds."""
    rng = np.random.default_rng(5)
    x = rng.integers(-500, 500, (400, 16))
    points = rng.integers(-500, 500, (30, 16))
    own, best, near, low = op13_drake.scan(x, op13_drake.Centroids(points, np.zeros(30)), 6)
    for turn in range(8):
        step = rng.integers(-40, 41, points.shape) // (turn + 1)
        points = points + step
        c = op13_drake.Centroids(points, np.sqrt((step**2).sum(1).astype(float)))
        near, low = op13_drake.narrowed(near, low, 6 - turn // 3)
        own, best, near, low, measured = op13_drake.advance(x, own, near, low, c)
        d = c.distances(x)
        assert (own == d.argmin(1)).all() and (best == d.min(1)).all()
        true = np.sqrt(d)
        assert (low[:, :-1] <= np.take_along_axis(true, near.astype(int), 1)).all()
        rest = true.copy()
        np.put_along_axis(rest, near.astype(int), np.inf, 1)
        rest[np.arange(len(x)), own] = np.inf
        assert (low[:, -1] <= rest.min(1)).all()
    assert (measured < 30).any()
