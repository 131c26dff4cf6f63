"""Benchmark decontamination: SimHash fingerprints of item-sized windows, Hamming blocks, exact weighted similarity.

A window of a shingles and an item of b >= a that share s of them (as multisets) are similar if s >= 4/9 (a + b), so
a + b - 2s <= 2b/9 shingles aren't shared. A fingerprint's bit is the sign of a sum of ones and minus ones, one for each
shingle, and unshared shingles move that sum by 2b/9 at most. So the item's firm bits, whose sum is further from zero
than that, are the same in every similar window, and the number of its other bits, the loose ones, is a radius that
no similar window leaves. An index over blocks of bits finds all windows that differ from an item in loose bits only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, table
from .textbytes import ALNUM_LOWER, LOWER, Hashes, counts, mix, pieces

WORDS = 5
#: Windows of a and b shingles that share s are similar (s / (a + b - s) is 0.8 or more) if SHARE[0] * s >= SHARE[1] * (a + b).
SHARE = 9, 4
#: Bits of a fingerprint's block.
BLOCK = 8
#: Bytes of benchmark text in one index; a larger benchmark is taken in parts of that size, of which a worker holds one.
INDEX_BYTES = 4 << 20
#: Windows that are fingerprinted at once.
WINDOWS = 512
_HASH_BITS = 20
_FOUND = T.StructType([T.StructField("items", T.ArrayType(T.LongType())), T.StructField("similarity", T.DoubleType()), T.StructField("windows", T.LongType())])


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n of the word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = mix(h + words[k : k + m])
    return h


def word_hashes(p) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word; A-Z are lower-cased."""
    low = LOWER[p.buf]
    s, e, row = p.spans(ALNUM_LOWER, low)
    return Hashes(low).of(s, e), row


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers starts[i] .. starts[i] + sizes[i] - 1 for all i end to end, and their i."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes), which


class Index:
    """Items by their distinct shingles and how often each stands in an item, and by their fingerprints' blocks."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        words = [np.zeros(0, np.uint64)] * len(ids)
        for p in pieces(pa.array(texts, pa.string())):
            h, row = word_hashes(p)
            bounds = np.searchsorted(row, np.arange(p.rows + 1))
            for r in range(p.rows):
                words[p.start + r] = h[bounds[r] : bounds[r + 1]].copy()
        keep = [i for i, w in enumerate(words) if len(w)]
        self.ids = np.array([ids[i] for i in keep], np.int64)
        self.length = np.array([len(words[i]) for i in keep], np.int64)
        cut = [shingle_hashes(words[i], min(WORDS, len(words[i]))) for i in keep]
        held = [np.unique(c, return_counts=True) for c in cut]
        flat = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in held)])
        times = np.concatenate([np.zeros(0, np.int64), *(t for _, t in held)])
        order = np.argsort(flat, kind="stable")
        self.key, self.first, self.many = np.unique(flat[order], return_index=True, return_counts=True)
        self.item = np.repeat(np.arange(len(keep)), [len(k) for k, _ in held])[order]
        self.times = times[order]
        self.seen = np.zeros(1 << _HASH_BITS, bool)
        self.seen[(self.key & np.uint64((1 << _HASH_BITS) - 1)).astype(np.int64)] = True
        self.short = sorted({int(n) for n in self.length if n < WORDS})
        #: items of one length make a group: the length, the items, and blocks[k, v], a bitset of those that a
        #: window whose k-th block is v may be similar to
        self.sizes, self.group = np.unique(self.length, return_inverse=True)
        self.members = [np.flatnonzero(self.group == g) for g in range(len(self.sizes))]
        self.blocks = [self._blocks([cut[i] for i in m]) for m in self.members]

    @staticmethod
    def _blocks(cut: list[np.ndarray]) -> np.ndarray:
        sums = np.array([2 * bits(h).sum(0, dtype=np.int64) - len(h) for h in cut])
        b = np.array([[len(h)] for h in cut])
        firm = np.packbits(9 * np.abs(sums) > 2 * b, axis=1, bitorder="little")
        value = np.packbits(sums > 0, axis=1, bitorder="little")
        differ = (np.arange(1 << BLOCK, dtype=np.uint8)[None, :, None] ^ value.T[:, None]) & firm.T[:, None]
        return np.packbits(differ == 0, axis=2)

    def near(self, g: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of group g whose fingerprints (windows x blocks) differ in loose bits of the item only."""
        found = self.blocks[g][0, prints[:, 0]]
        for k in range(1, prints.shape[1]):
            found = found & self.blocks[g][k, prints[:, k]]
        w, i = np.nonzero(np.unpackbits(found, axis=1, count=len(self.members[g])))
        return w, self.members[g][i]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of h that are a shingle of some item, and its number."""
        at = np.flatnonzero(self.seen[(h & np.uint64((1 << _HASH_BITS) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.key, h[at]), max(0, len(self.key) - 1))
        same = self.key[k] == h[at] if len(self.key) else np.zeros(0, bool)
        return at[same], k[same]

    def _slide(self, at: list[int], post: list[int], times: list[int], starts: list[int], own: int, wide: int) -> tuple[float, int]:
        """Best similarity and number of the similar windows (wide shingles from each of starts, which ascend) to one
        item (own shingles) that has its shingle post[i], times[i] times, at place at[i]. Counts roll along, so the
        work is linear in the hits."""
        held: dict[int, int] = {}
        best, many, shared, left, right = 0.0, 0, 0, 0, 0
        for s in starts:
            while right < len(at) and at[right] < s + wide:
                k = post[right]
                held[k] = held.get(k, 0) + 1
                shared += held[k] <= times[right]
                right += 1
            while left < right and at[left] < s:
                k = post[left]
                shared -= held[k] <= times[left]
                held[k] -= 1
                left += 1
            if SHARE[0] * shared >= SHARE[1] * (own + wide):
                best, many = max(best, shared / (own + wide - shared)), many + 1
        return best, many

    def scan(self, p) -> dict[int, tuple[set[int], float, int]]:
        """Row of a piece: the items that a window of it is similar to, the best similarity, how many windows are."""
        out: dict[int, tuple[set[int], float, int]] = {}
        if not len(self.length):
            return out
        words, row = word_hashes(p)
        total = counts(row, p.rows)
        begin = np.cumsum(total) - total
        for n in [WORDS, *self.short]:
            h = shingle_hashes(words, n)
            at, k = self.hits(h)
            inside = row[at] == row[at + n - 1] if len(at) else np.zeros(0, bool)
            at, k = at[inside], k[inside]
            if not len(at):
                continue
            post, which = spread(self.first[k], self.many[k])
            fits = np.minimum(self.length[self.item[post]], WORDS) == n
            post, at = post[fits], at[which][fits]
            if not len(at):
                continue
            r, group, start, size = self._windows(at, row[at], self.group[self.item[post]], n, begin, total)
            wide = size - n + 1
            found = []
            for lo in range(0, len(start), WINDOWS):
                part = slice(lo, lo + WINDOWS)
                prints = fingerprints(h, start[part], wide[part])
                for g in np.unique(group[part]).tolist():
                    mine = lo + np.flatnonzero(group[part] == g)
                    w, item = self.near(g, prints[mine - lo])
                    found.append((mine[w], item))
            if not found:
                continue
            w, item = (np.concatenate(x) for x in zip(*found, strict=True))
            self._verify(out, r[w], item, start[w], wide[w], n, at, post, row)
        return out

    def _windows(self, at, r, group, n, begin, total) -> tuple[np.ndarray, ...]:
        """Rows, groups, starts (ascending) and words of the windows that may be similar to an item of a group: those of its
        size (the whole text if that is shorter) that hold as many places of its shingles (at) as similarity needs."""
        order = np.lexsort((at, r, group))
        at, r, group = at[order], r[order], group[order]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (r[1:] != r[:-1]) | (group[1:] != group[:-1])))
        at, r, group = at[new], r[new], group[new]
        size = np.minimum(self.sizes[group], total[r])
        wide = size - n + 1
        need = -(-SHARE[1] * (self.sizes[group] - n + 1 + wide) // SHARE[0])
        i = np.arange(len(at))
        last = i + need - 1
        i = i[last < len(at)]
        last = last[i]
        i, last = (x[(r[last] == r[i]) & (group[last] == group[i]) & (at[last] - at[i] < wide[i])] for x in (i, last))
        lo, hi = np.maximum(at[last] - wide[i] + 1, begin[r[i]]), np.minimum(at[i], (begin + total)[r[i]] - size[i])
        start, which = spread(lo, np.maximum(hi - lo + 1, 0))
        i = i[which]
        order = np.lexsort((group[i], start))
        start, i = start[order], i[order]
        new = np.concatenate(([True], (start[1:] != start[:-1]) | (group[i[1:]] != group[i[:-1]]))) if len(i) else np.zeros(0, bool)
        start, i = start[new], i[new]
        return r[i], group[i], start, size[i]

    def _verify(self, out, r, item, start, wide, n, at, post, row) -> None:
        """Adds to out the candidates (row, item, start, wide) that are similar; at and post are the hits."""
        hit = np.lexsort((at, self.item[post], row[at]))
        at, post = at[hit], post[hit]
        pair = row[at] * len(self.length) + self.item[post]
        order = np.lexsort((start, item, r))
        r, item, start, wide = r[order], item[order], start[order], wide[order]
        mine = r * len(self.length) + item
        new = np.flatnonzero(np.diff(mine, prepend=-1)).tolist()
        for a, b in zip(new, [*new[1:], len(mine)], strict=True):
            lo, hi = np.searchsorted(pair, [mine[a], mine[a] + 1])
            if lo == hi:
                continue
            x, i = int(r[a]), int(item[a])
            best, many = self._slide(at[lo:hi].tolist(), post[lo:hi].tolist(), self.times[post[lo:hi]].tolist(), start[a:b].tolist(), int(self.length[i]) - n + 1, int(wide[a]))
            if many:
                items, most, windows = out.get(x, (set(), 0.0, 0))
                out[x] = (items | {int(self.ids[i])}, max(most, best), windows + many)


def bits(h: np.ndarray) -> np.ndarray:
    """The 64 bits of each hash."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(h: np.ndarray, start: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Blocks of the SimHash fingerprints of windows: a bit is set if it is in over half of the wide hashes from start."""
    held = np.zeros(int((start + wide).max() - start.min()) + 1, np.int64)
    np.add.at(held, start - start.min(), 1)
    np.add.at(held, start + wide - start.min(), -1)
    held = np.cumsum(held)[:-1] > 0
    rank = np.concatenate(([0], np.cumsum(held)))
    at = np.flatnonzero(held) + start.min()
    sums = np.zeros((len(at) + 1, 64), np.int32)
    np.cumsum(bits(h[at]), axis=0, dtype=np.int32, out=sums[1:])
    first = start - start.min()
    many = sums[rank[first + wide]] - sums[rank[first]]
    return np.packbits(2 * many > wide[:, None], axis=1, bitorder="little")


def _searched(parts: list[Broadcast]):
    """A UDF over the parts of an index; a worker holds one of them at a time, and keeps it if there is no other."""

    @F.arrow_udf(_FOUND)
    def run(texts: pa.Array) -> pa.Array:
        items: list[set[int]] = [set() for _ in range(len(texts))]
        best, many = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for part in parts:
            index = part.value
            for p in pieces(texts):
                for r, (found, similarity, n) in index.scan(p).items():
                    r += p.start
                    items[r] |= found
                    best[r], many[r] = max(best[r], similarity), many[r] + n
            if len(parts) > 1:
                index = part._value = None
                del part._value
        return pa.StructArray.from_arrays([pa.array(map(sorted, items), pa.list_(pa.int64())), pa.array(best), pa.array(many)], ["items", "similarity", "windows"])

    return run


def matches(benchmark: DataFrame, text: str | Column) -> Column:
    """Struct for a text column: items (ascending ids), similarity (the best, 0 if none), windows (that match).

    benchmark: item_id, text. Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the lower-cased text. A window of as
    many words as an item has (the whole text if that is shorter) matches if the multisets of its and the item's
    5-word shingles have a weighted Jaccard similarity of 0.8 or more; an item of fewer words matches only itself.
    No match is lost (see the module's head), whatever the order of the shingles. Null or blank items and items
    without an id match nothing, null or blank texts contain nothing; rows that repeat an id are items of their own,
    reported once. The index goes to tasks in parts of INDEX_BYTES of text at most.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    slim = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    parts = -(-(slim.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // INDEX_BYTES)
    held = []
    for k in range(parts):
        rows = slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        held.append(benchmark.sparkSession.sparkContext.broadcast(Index([x.item_id for x in rows], [x.text for x in rows])))
    return _searched(held)(text)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, items, similarity, windows (see matches()) for every row of docs (doc_id, text); repeated rows give a row
    each, an empty table gives an empty one, other columns are ignored."""
    return docs.select("doc_id", matches(benchmark, "text").alias("m")).select("doc_id", "m.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text matches no item of the benchmark, with all columns, whatever their names; null and
    empty texts stay, repeated rows stay or go together, an empty table or benchmark takes nothing away."""
    m = free(docs, "m")
    return docs.withColumn(m, matches(benchmark, "text")).where(F.size(F.col(m)["items"]) == 0).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", F.round("similarity", 6).alias("similarity"), "windows")
