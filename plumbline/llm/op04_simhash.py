"""SimHash near-duplicates: pivot distance tables discard pairs of fingerprints, the Hamming distance verifies the rest."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import free, materialize, release, table
from .components import connected_components
from .textbytes import LOWER, NON_SPACE, counts, pieces

RADIUS = 2
#: Bits of a fingerprint are cut into this many blocks; two fingerprints within RADIUS bits agree on all but RADIUS of them.
BLOCKS = 4
PIVOTS = 16
#: The first CELLS pivots' distances, cut into ranges of 2 * RADIUS + 1, divide every bucket into cells.
CELLS = 2
#: Fingerprints of a cell up to which its pairs are looked at; fuller cells take the exact way of meeting().
FULL = 32
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]


def simhash_of(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Bit i of row r: set in over half of the 64-bit hashes h whose rows[] is r; rows ascend. Without hashes: 0."""
    out = np.zeros(n, np.uint64)
    if not len(h):
        return out
    new = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    size = np.diff(np.append(new, len(h)))
    # a byte holds a bit's count of up to 255 hashes, so that eight bits are added at once
    parts = -(-size // 255)
    first = np.cumsum(parts) - parts
    start = np.repeat(new, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    octets = h.view(np.uint8).reshape(-1, 8)
    fp = np.zeros(len(new), np.uint64)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[octets[:, k]], start).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
        bits = np.packbits(2 * total > size[:, None], axis=1, bitorder="little")[:, 0].astype(np.uint64)
        fp |= bits << np.uint64(8 * k)
    out[rows[new]] = fp
    return out


def piece_fingerprints(piece, ngram: int, seed: int) -> np.ndarray:
    s, e, row = piece.spans(NON_SPACE)
    # words end to end, one space after each
    low = LOWER[piece.buf]
    size = e - s
    to = np.cumsum(size + 1)
    at = to - size - 1
    joined = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    keep = np.repeat(at - s, size) + np.flatnonzero(NON_SPACE[piece.buf]) if len(s) else np.zeros(0, np.int64)
    joined[keep] = low[NON_SPACE[piece.buf]]
    words = counts(row, piece.rows)
    before = np.cumsum(words) - words
    first = np.arange(len(s))
    last = first + np.minimum(ngram, words[row]) - 1
    whole = last < (before + words)[row]
    if len(s):
        whole &= (words[row] >= ngram) | (first == before[row])
    first, last = first[whole], last[whole]
    blob = joined.tobytes()
    cut = [blob[a:b] for a, b in zip(at[first].tolist(), (to[last] - 1).tolist(), strict=True)]
    h = np.fromiter(map(xxh64_intdigest, cut, repeat(seed)), np.uint64, len(cut))
    return simhash_of(h, row[first], piece.rows)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, seed: int = 42) -> DataFrame:
    """id, fp (64 bits as a long) of every row; a null text counts as empty and has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b.column(1)):
                fp = piece_fingerprints(p, ngram, seed)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(p.start, p.rows).cast(pa.int64()), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: hashes of 0..n-1, as signed longs."""
    return [int(np.uint64(xxh64_intdigest(i.to_bytes(8, "little"), 7)).view(np.int64)) for i in range(n)]


def hamming(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def links_within(classes: DataFrame) -> DataFrame:
    """Links u, v of the distinct fingerprints fp that differ in RADIUS bits or fewer, or paths of such links.

    Two such fingerprints agree on BLOCKS - RADIUS blocks of bits, so each is dealt to a bucket for every choice of that
    many blocks. Within a bucket the pivot tables make the candidates: distances to a pivot of a linked pair differ by
    RADIUS at most (triangle inequality), so one of them, in the cell of its own distances, meets the other in one of
    the cells that its distances less or more RADIUS reach. Candidates whose distances to some pivot differ by more are
    discarded; the survivors' Hamming distance is computed. A cell of over FULL fingerprints goes to meeting()
    instead, which is exact too and makes no pairs.
    """
    width = 64 // BLOCKS
    block = [F.shiftrightunsigned("fp", width * i).bitwiseAND((1 << width) - 1) for i in range(BLOCKS)]
    keys = [
        F.struct(F.lit(t).cast("byte").alias("t"), F.shiftleft(block[i], width).bitwiseOR(block[j]).alias("k"))
        for t, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS))
    ]
    known = classes.select("fp", F.array(*(hamming("fp", F.lit(p)).cast("byte") for p in pivots())).alias("far"))
    dealt = known.select("fp", "far", F.explode(F.array(*keys)).alias("key"))
    held = dealt.groupBy("key").agg(F.count("*").alias("held")).where("held > 1").drop("held")
    dealt = materialize(dealt.join(held, "key"), "buckets")

    def cell(i: int, more: int) -> Column:
        return F.floor((F.get("far", F.lit(i)) + more) / (2 * RADIUS + 1)).cast("int")

    names = [f"c{i}" for i in range(CELLS)]
    own = dealt.select("key", "fp", "far", *(cell(i, 0).alias(c) for i, c in enumerate(names)))
    wide = dealt
    for i, c in enumerate(names):
        wide = wide.withColumn(c, F.explode(F.sequence(cell(i, -RADIUS), cell(i, RADIUS))))
    full = materialize(wide.groupBy("key", *names).agg(F.count("*").alias("held")).where(f"held > {FULL}").drop("held"), "crowded")
    a, b = own.join(full, ["key", *names], "left_anti").alias("a"), wide.alias("b")
    apart = F.greatest(*(F.abs(F.get("a.far", F.lit(i)) - F.get("b.far", F.lit(i))) for i in range(PIVOTS)))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in names]
    pairs = a.join(b, [F.col("a.key") == F.col("b.key"), *same, F.col("a.fp") < F.col("b.fp"), apart <= RADIUS, hamming("a.fp", "b.fp") <= RADIUS])
    close = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    return close.union(meeting(wide.join(full, ["key", *names], "left_semi").select("fp").distinct()))


def meeting(dense: DataFrame) -> DataFrame:
    """Exact links at two bits for crowded regions: two fingerprints differ in at most two bits if and only if some
    value lies within one bit of both. Each fingerprint goes to the 65 values around it; at most 65 meet at one."""
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(int(np.uint64(1 << i).view(np.int64)))) for i in range(64)))
    met = dense.select("fp", F.explode(around).alias("at"))
    least = met.groupBy("at").agg(F.min("fp").alias("v"), F.collect_set("fp").alias("all"))
    return least.where(F.size("all") > 1).select(F.explode("all").alias("u"), "v").where("u <> v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of docs: id, fp, component (smallest id reachable by links of RADIUS bits, itself included).

    Null or blank texts have fingerprint 0 and are linked like others. Repeated rows and ids give a row each. A null
    id never is the smallest unless its component has no other. An empty table gives an empty one.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, ngram, seed), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = connected_components(links_within(classes))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(smallest, "root").select("fp", "component")
    return fps.join(named, "fp").select("id", "fp", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the first (smallest id) of their component, with all columns, whatever their names.

    Of rows that repeat an id, all stay or go together. Rows without an id stay only where their component has no id.
    Null and empty texts are copies of each other. An empty table gives an empty one.
    """
    found = near_duplicates(docs, id_col, text_col)
    kept = free(docs, "kept")
    ids = found.where(F.col("component").eqNullSafe(F.col("id"))).select(F.col("id").alias(kept)).distinct()
    return docs.join(ids, docs[id_col].cast("long").eqNullSafe(F.col(kept)), "left_semi")
