"""Fuzzy line dedup: MinHash signatures of character shingles, banding, exact Jaccard verification, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import free, materialize, release, table
from .components import connected_components
from .textbytes import NON_SPACE, PIECE, Hashes, Piece, class_table, counts, mix, pieces

#: Characters of a shingle; a shorter line is one shingle.
SHINGLE = 8
SIMILAR = 0.8
#: A signature has BANDS x ROWS minima. Lines of similarity s meet in a band with probability 1 - (1 - s^ROWS)^BANDS:
#: 0.985 at 0.8, 0.997 at 0.85, 0.9998 at 0.9. BANDS is 8, as the low three bits of a band key are the band's number.
BANDS, ROWS = 8, 4
#: Times that the lines of a bucket which its hub isn't similar to are compared with a hub of their own.
HUBS = 3
#: Rows of one bucket that are looked at together for its hub; a larger bucket keeps the hub of its first rows.
RUN = 1 << 16
#: Places of the sketches that discard pairs, a multiple of 64.
SKETCH_BITS = 1024
#: Filters that say which lines may be asked for have 16 bits a key, up to this many (16 MB); fuller ones only let more pass.
FILTER_BITS = 1 << 27
_LINE = class_table(b"\n")
_TURNS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).astype(np.uint32)


def worded_lines(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and numbers (from 0 in each text, blank lines counted) of the \\n-split lines with a word."""
    s, e, row = p.spans(_LINE)
    if not len(s):
        return s, e, row, s
    inside = np.concatenate(([0], np.cumsum(NON_SPACE[p.buf], dtype=np.int64)))
    worded = inside[e] > inside[s]
    s, e, row = s[worded], e[worded], row[worded]
    breaks = np.concatenate(([0], np.cumsum(p.buf == 10, dtype=np.int64)))
    return s, e, row, breaks[s] - breaks[p.offs[row]]


def shingles(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of the byte ranges s:e, end to end, and where each range's begin. A shingle of
    eight bytes is hashed as one number, any other by Hashes."""
    lead = (buf & 0xC0) != 0x80
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    ascii_ = bool(lead.all())
    if ascii_:
        a, b = s, e
    else:
        lead[0] = True
        chars = np.append(np.flatnonzero(lead), len(buf))
        a, b = np.searchsorted(chars, s), np.searchsorted(chars, e)
    many = np.maximum(b - a - SHINGLE + 1, 1)
    at = np.cumsum(many) - many
    first = np.arange(int(many.sum())) + np.repeat(a - at, many)
    if ascii_:
        h = mix(eight[first])
        short = np.flatnonzero(e - s < SHINGLE)
        odd, lo, hi = at[short], s[short], e[short]
    else:
        lo, hi = chars[first], chars[np.minimum(first + SHINGLE, np.repeat(b, many))]
        h = mix(eight[lo])
        odd = np.flatnonzero(hi - lo != 8)
        lo, hi = lo[odd], hi[odd]
    if len(odd):
        h[odd] = Hashes(buf).of(lo, hi)
    return h, at


def bands_of(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Band keys (BANDS x lines). The i-th minimum is that of the shingles' hashes xor-ed with the i-th constant: the
    shingle nearest to a fixed point, which two lines share with the probability of their Jaccard similarity."""
    out = np.empty((BANDS, len(at)), np.uint64)
    h = (h >> np.uint64(32)).astype(np.uint32)
    turned = np.empty_like(h)
    for band in range(BANDS):
        key = np.full(len(at), band + 1, np.uint64)
        for r in range(ROWS):
            np.bitwise_xor(h, _TURNS[band * ROWS + r], out=turned)
            key = mix(key + np.minimum.reduceat(turned, at).astype(np.uint64))
        out[band] = key & ~np.uint64(7) | np.uint64(band)
    return out.view(np.int64)


def signatures(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """bands_of() the byte ranges s:e, which ascend, about PIECE bytes of them at once."""
    out = np.zeros((BANDS, len(s)), np.int64)
    lo = 0
    while lo < len(s):
        hi = max(lo + 1, int(np.searchsorted(e, s[lo] + PIECE, "right")))
        out[:, lo:hi] = bands_of(*shingles(buf[s[lo] : e[hi - 1]], s[lo:hi] - s[lo], e[lo:hi] - s[lo]))
        lo = hi
    return out


def line_keys(p: Piece, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    blob = memoryview(p.buf)
    return np.fromiter((xxh3_64_intdigest(blob[a:b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)), np.uint64, len(s)).view(np.int64)


def _row_ids(ids: pa.Array, texts: pa.Array) -> np.ndarray:
    """Repeated rows, of one id and one text, have one row id."""
    made = (xxh3_64_intdigest(f"{i} {'-' if t is None else '+'}{t}") for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True))
    return np.fromiter(made, np.uint64, len(ids)).view(np.int64)


def touched_id(ids: Column, texts: Column, filter_: np.ndarray) -> Column:
    """The row id where the filter of row ids may hold it, else null."""
    held = SparkSession.active().sparkContext.broadcast(filter_)

    @F.arrow_udf(T.LongType())
    def run(i: pa.Array, t: pa.Array) -> pa.Array:
        uid = _row_ids(i, t)
        return pa.array(uid, mask=~_maybe(held.value, uid))

    return run(ids, texts)


_BAND_COLUMNS = [f"b{i}" for i in range(BANDS)]
_SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
_LINES = "uid long, id long, line int, n int, key long, " + ", ".join(f"{c} long" for c in _BAND_COLUMNS)


def lines(docs: DataFrame) -> DataFrame:
    """Of docs (id, text), a row for every worded line: uid, id, line, key, b0, b1, ... (null where an equal line of
    the same piece of a batch has them), and one with line -1 for every text, whose n is the number of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid = _row_ids(b.column(0), b.column(1))
            for p in pieces(b.column(1)):
                s, e, row, number = worded_lines(p)
                keys = line_keys(p, s, e)
                new = np.sort(np.unique(keys, return_index=True)[1])
                n, m = p.rows, len(s)
                bands = np.zeros((BANDS, n + m), np.int64)
                bands[:, n + new] = signatures(p.buf, s[new], e[new])
                none = np.ones(n + m, bool)
                none[n + new] = False
                rows = np.concatenate([np.arange(n), row]) + p.start
                text = np.arange(n + m) < n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid[rows]),
                        b.column(0).take(pa.array(rows)),
                        pa.array(np.concatenate([np.full(n, -1), number]).astype(np.int32)),
                        pa.array(np.concatenate([counts(row, n), number]).astype(np.int32), mask=~text),
                        pa.array(np.concatenate([np.zeros(n, np.int64), keys]), mask=text),
                        *(pa.array(c, mask=none) for c in bands),
                    ],
                    ["uid", "id", "line", "n", "key", *_BAND_COLUMNS],
                )

    return docs.mapInArrow(run, _LINES)


def _wanted(keys: DataFrame) -> np.ndarray:
    """A filter over keys (key), a written table: 64 bits to a word. What reaches the driver is FILTER_BITS at most."""
    words = 1 << 10
    while words * 64 < min(FILTER_BITS, 16 * keys.count()):
        words *= 2
    word = F.pmod("key", F.lit(words)).alias("word")
    found = keys.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 40) & 63 as int))")).alias("bits"))
    out = np.zeros(words, np.int64)
    got = found.toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def _maybe(filter_: np.ndarray, key: np.ndarray) -> np.ndarray:
    bits = filter_[key % len(filter_)] >> ((key.view(np.uint64) >> np.uint64(40)) & np.uint64(63))
    return (bits & np.uint64(1)).astype(bool)


def line_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, body of the lines of docs (id, text) whose key is in keys (key, a written table), once each; a written table."""
    held = docs.sparkSession.sparkContext.broadcast(_wanted(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = held.value
        for b in batches:
            for p in pieces(b.column(0)):
                s, e, _, _ = worded_lines(p)
                key = line_keys(p, s, e)
                at = np.flatnonzero(_maybe(filter_, key))
                if len(at):
                    at = at[np.unique(key[at], return_index=True)[1]]
                    blob = p.buf.tobytes()
                    body = [blob[x:y] for x, y in zip(s[at].tolist(), e[at].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(body, pa.binary())], ["key", "body"])

    found = docs.select("text").mapInArrow(run, "key long, body binary")
    out = materialize(found.join(keys, "key", "left_semi").groupBy("key").agg(F.first("body").alias("body")), "bodies")
    held.destroy()
    return out


def _slices(batch: pa.RecordBatch, columns: list[int]) -> Iterator[pa.RecordBatch]:
    """Slices of up to 1024 rows whose binary columns hold about 4 x PIECE bytes."""
    size = np.cumsum(sum(np.asarray(pc.binary_length(batch.column(c)), np.int64) for c in columns))
    lo = 0
    while lo < batch.num_rows:
        before = size[lo - 1] if lo else 0
        hi = min(lo + 1024, max(lo + 1, int(np.searchsorted(size, before + 4 * PIECE, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _shingle_sets(bodies: pa.Array) -> np.ndarray:
    """The distinct shingles of each of up to 1024 bodies, ascending: row << 54 | 54 bits of the hash."""
    out = [np.zeros(0, np.uint64)]
    for p in pieces(bodies):
        h, at = shingles(p.buf, p.offs[:-1], p.offs[1:]) if len(p.buf) else (np.zeros(p.rows, np.uint64), np.arange(p.rows))
        row = np.repeat(np.arange(p.start, p.start + p.rows, dtype=np.uint64), np.diff(np.append(at, len(h))))
        out.append(row << np.uint64(54) | h >> np.uint64(10))
    x = np.sort(np.concatenate(out))
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _rows_of(x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount((x >> np.uint64(54)).astype(np.int64), minlength=n)


def jaccard(pairs: DataFrame) -> DataFrame:
    """u, v, similarity of pairs (u, v, a, b): exact Jaccard similarity of the shingle sets of the bodies a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch, [2, 3]):
                x, y = _shingle_sets(b.column(2)), _shingle_sets(b.column(3))
                both = np.sort(np.concatenate([x, y]))
                shared = _rows_of(both[1:][both[1:] == both[:-1]], b.num_rows)
                union = _rows_of(x, b.num_rows) + _rows_of(y, b.num_rows) - shared
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared / union)], ["u", "v", "similarity"])

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long, similarity double")


def sketches(bodies: DataFrame) -> DataFrame:
    """key, m (distinct shingles), s0, s1, ... (parities of the shingles by SKETCH_BITS places) of bodies (key, body).

    Two sketches differ in no more places than their sets have unshared shingles, so that what they discard is never
    similar.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch, [1]):
                x, n = _shingle_sets(b.column(1)), b.num_rows
                place = (x >> np.uint64(54)) * np.uint64(SKETCH_BITS) + mix(x << np.uint64(10)) % np.uint64(SKETCH_BITS)
                odd = (np.bincount(place.astype(np.int64), minlength=n * SKETCH_BITS) & 1).astype(bool)
                words = np.packbits(odd).view(np.int64).reshape(n, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_rows_of(x, n)), *(pa.array(w) for w in words.T.copy())], ["key", "m", *_SKETCH])

    return bodies.select("key", "body").mapInArrow(run, "key long, m long, " + ", ".join(f"{c} long" for c in _SKETCH))


def _may_be_similar(x: str, y: str) -> Column:
    """Whether the sketches of two sides (their alias) allow a similarity of SIMILAR."""
    unshared = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in _SKETCH[1:]), F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))))
    m, n = F.col(f"{x}.m"), F.col(f"{y}.m")
    return F.greatest(unshared.cast("long"), F.abs(m - n)) * (1 + SIMILAR) <= (m + n) * (1 - SIMILAR) + 1e-6


def _similar(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (u, v) whose exact similarity is SIMILAR or more."""
    left, right = bodies.select(F.col("key").alias("u"), F.col("body").alias("a")), bodies.select(F.col("key").alias("v"), F.col("body").alias("b"))
    return jaccard(pairs.join(left, "u").join(right, "v")).where(f"similarity >= {SIMILAR}").select("u", "v")


def buckets(found: DataFrame) -> DataFrame:
    """band, key, hub, met, edge, repeats: the lines of found (lines()) that share a band with others, or may be repeated.

    Rows are range-partitioned by band and key, so that a band of any size is dealt over as many tasks as it fills, and
    each task streams its sorted rows. hub is the line of the bucket that most pieces have, within a task; met: the
    bucket may have another line; edge: the bucket may go on in another task, which then has a hub of its own; repeats:
    the line may stand in more than one piece (told in band 0 only).
    """
    dealt = found.where("b0 is not null").select("key", "uid", F.explode(F.array(*_BAND_COLUMNS)).alias("band"))
    by = ["band", "key", "uid"]
    return dealt.repartitionByRange(*by).sortWithinPartitions(*by).select("band", "key").mapInArrow(_bucket_rows, "band long, key long, hub long, met boolean, edge boolean, repeats boolean")


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band = key = np.zeros(0, np.int64)
    known: tuple[int, int] | None = None  # band and hub of a bucket whose first rows are gone
    begun = False

    def rows(band: np.ndarray, key: np.ndarray, last: bool) -> pa.RecordBatch:
        nonlocal known, begun
        at = np.flatnonzero(np.concatenate(([True], (band[1:] != band[:-1]) | (key[1:] != key[:-1]))))
        times = np.diff(np.append(at, len(band)))
        b, k = band[at], key[at]
        new = np.concatenate(([True], b[1:] != b[:-1]))
        run = np.cumsum(new) - 1
        many = np.bincount(run)
        top = k[np.lexsort((k, -times, run))[np.flatnonzero(new)]]
        edge = np.zeros(len(many), bool)
        if known and known[0] == b[0]:
            top[0] = known[1]
            many[0] += 1
            edge[0] = not begun
        edge[0] |= not begun
        edge[-1] |= last
        known = (int(b[-1]), int(top[-1]))
        ends = np.zeros(len(k), bool)
        ends[0] = ends[-1] = True
        twice = ((times > 1) | ends) & (b & 7 == 0)
        met = (many > 1) | edge
        begun = True
        keep = met[run] | twice
        out = [b, k, top[run], met[run], edge[run], twice]
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in out], ["band", "key", "hub", "met", "edge", "repeats"])

    for batch in batches:
        band, key = np.concatenate([band, batch.column(0).to_numpy()]), np.concatenate([key, batch.column(1).to_numpy()])
        if not len(band):
            continue
        cut = int(np.searchsorted(band, band[-1]))
        if not cut and len(band) >= RUN:
            cut = len(band)
        if cut:
            yield rows(band[:cut], key[:cut], False)
            band, key = band[cut:], key[cut:]
    if len(band):
        yield rows(band, key, True)


def _around_hubs(apart: DataFrame) -> DataFrame:
    """band, key, hub of the lines of apart (band, key) that aren't alone in their bucket, a hub for each, but for hubs."""
    hubs = apart.groupBy("band").agg(F.min("key").alias("hub"), F.max("key").alias("high")).where("hub <> high").drop("high")
    return apart.select("band", "key").join(hubs, "band").where("key <> hub")


def line_links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Links u, v (docs: id, text; found: lines() of it) that join the same lines as all links within buckets do."""
    return line_roots(docs, materialize(buckets(found), "buckets")).select(F.col("node").alias("u"), F.col("root").alias("v"))


def line_roots(docs: DataFrame, star: DataFrame) -> DataFrame:
    """node, root (docs: id, text; star: a written table of its buckets()): the same components as all links within
    buckets make.

    In each bucket of a band every line is compared with the bucket's hub, its line with most copies, since the other
    variants of a much copied line lie around it. Lines that aren't similar to it form a bucket among themselves with
    a hub of its own, HUBS times. So a bucket makes no more pairs in a turn than it has lines, whatever its size.
    Lines that the hubs leave in another component than most of their bucket are then compared with the bucket's lines
    of other components, where sketches discard pairs before a text is fetched, and none that is similar.
    """
    met = star.where("met")
    keys = materialize(met.select("key").distinct(), "keys")
    bodies = line_texts(docs, keys)
    release(keys)
    # the hubs of a bucket that several tasks hold are compared with one of them
    split = met.where("edge").select("band", F.col("hub").alias("key")).distinct()
    left = met.where("key <> hub").select("band", "key", "hub").unionByName(_around_hubs(split))
    links, held = [], []
    for turn in range(HUBS):
        pairs = left.select(F.col("key").alias("u"), F.col("hub").alias("v")).distinct()
        links.append(materialize(_similar(pairs, bodies), "near"))
        if turn + 1 < HUBS:
            apart = left.join(links[-1], (F.col("key") == F.col("u")) & (F.col("hub") == F.col("v")), "left_anti")
            left = materialize(_around_hubs(apart), "star")
            held.append(left)
            if left.isEmpty():
                break
    near = links[0]
    for x in links[1:]:
        near = near.union(x)
    roots = connected_components(near)
    pairs = _across_components(met.select("band", "key"), roots, bodies)
    found = materialize(_similar(pairs, bodies), "near")
    # what those links join are whole components, so only their roots need to be joined
    mine = [roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "uv"]
    ends = found.join(mine[0], "u", "left").join(mine[1], "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    more = connected_components(ends)
    joined = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("first")), "root", "left")
    all_ = materialize(joined.select("node", F.coalesce("first", "root").alias("root")).unionByName(more), "roots")
    for x in (*links, *held, pairs, found, bodies, roots, more):
        release(x)
    return all_


def _across_components(met: DataFrame, roots: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pairs u, v of different components in a bucket of met (band, key) that may be similar, once each; a written table.

    Components with most lines in their bucket are not compared within themselves, so a bucket around one line costs
    its strays times its lines.
    """
    named = materialize(met.join(roots, F.col("key") == F.col("node"), "left").select("band", "key", F.coalesce("root", "key").alias("root")), "named")
    main = named.groupBy("band", "root").count().groupBy("band").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots"))
    main = materialize(main.where("roots > 1").select("band", "main"), "main")
    mixed = materialize(named.join(main, "band"), "mixed")
    some = materialize(sketches(bodies.join(mixed.select("key").distinct(), "key", "left_semi")), "sketches")
    held = materialize(mixed.join(some, "key"), "held")
    release(named)
    stray, other = held.where("root <> main").alias("x"), held.alias("y")
    differ = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.key") < F.col("y.key")))
    pairs = stray.join(other, (F.col("x.band") == F.col("y.band")) & differ & _may_be_similar("x", "y"))
    out = materialize(pairs.select(F.col("x.key").alias("u"), F.col("y.key").alias("v")).distinct(), "across")
    for x in (main, mixed, some, held):
        release(x)
    return out


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of docs (id, text), written tables of the texts (uid, id, n_lines) and the lines that go (uid, removed: ascending
    line numbers).

    Of each component of similar lines the first stays, by id (null last), row id and line number. Only lines that
    are repeated or linked are looked at: all else is the only line of its component.
    """
    found = materialize(lines(docs), "lines")
    star = materialize(buckets(found), "buckets")
    roots = line_roots(docs, star)
    again = star.where("repeats").select("key").union(found.where("line >= 0 and b0 is null").select("key"))
    linked = roots.select(F.col("node").alias("key")).union(roots.select(F.col("root").alias("key")))
    some = again.union(linked).distinct().join(roots, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("root"))
    some = materialize(some, "some")
    at = found.where("line >= 0").select("key", F.struct(F.col("id").isNull().alias("no"), "id", "uid", "line").alias("at"))
    named = materialize(at.join(some, "key").select("at", "root"), "occurrences")
    # a written table, so that the join with it can split a component that much of the lines belong to
    firsts = materialize(named.groupBy("root").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").drop("last"), "firsts")
    gone = named.join(firsts, "root").where("at <> first").select("at.uid", "at.line").distinct()
    gone = materialize(gone.groupBy("uid").agg(F.array_sort(F.collect_list("line")).alias("removed")), "gone")
    texts = materialize(found.where("line < 0").select("uid", "id", F.col("n").alias("n_lines")), "texts")
    for x in (found, star, roots, some, named, firsts):
        release(x)
    return texts, gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines (\\n-split lines with a word), removed (numbers of the lines that go, blank lines counted).

    One row per row of docs. Lines without a word stay and are not counted. A null or blank text has no lines. Rows
    that repeat an id and a text are one document: each keeps and loses the same lines. Of equal lines the first stays
    (smallest id, null last; then by a hash of the row, then by line). An empty table gives an empty one; other columns
    are ignored. Lines are told apart by 64-bit hashes.
    """
    texts, gone = removals(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return texts.join(gone, "uid", "left").select(
        F.col("id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed")
    )


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, removed: pa.Array) -> pa.Array:
    """The text without the lines of these numbers; null lists leave it as it is."""
    out = []
    for t, gone in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
        if t is not None and gone:
            at = set(gone)
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in at)
        out.append(t)
    return pa.array(out, pa.string())


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without the lines that repeat an earlier one; rows that lose every worded line go.

    Lines go as dedup_lines() says; rows without a worded line, null texts among them, stay as they are, and rows that
    repeat an id and a text stay or go together. Other columns pass, whatever their names; n_chars, if there is one,
    follows the text. Only texts that may lose a line, by a filter of row ids, are shuffled.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts, gone = removals(slim)
    release(texts)
    uid, lost = free(docs, "uid"), free(docs, "removed")
    gone = gone.select(F.col("uid").alias(uid), F.col("removed").alias(lost))
    marked = docs.withColumn(uid, touched_id(F.col(id_col).cast("long"), F.col(text_col), _wanted(gone.select(F.col(uid).alias("key")))))
    joined = marked.where(F.col(uid).isNotNull()).join(gone.hint("merge"), uid, "left")
    changed = F.col(lost).isNotNull()
    out = joined.withColumn(text_col, _without(text_col, lost)).where(~changed | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns).unionByName(marked.where(F.col(uid).isNull()).select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", (F.col("n_lines") - F.size("removed")).alias("n_kept"), "removed")
