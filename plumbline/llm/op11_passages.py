"""Substring dedup: recurring passages are confirmed, compiled into sharded Aho-Corasick automata, and located everywhere.

A window is WINDOW consecutive words of one document. Those whose words occur again are confirmed by counting hashes.
Where a window occurs first, runs of such windows make a passage. A shard holds the passages of some documents. Of every
passage each (WINDOW - PHRASE + 1)-th phrase of PHRASE words goes into the shard's automaton, so that each of its windows
holds a phrase whole. Documents stream through the automata of the shards whose passages they may hold; each phrase found
is extended by comparing words, so that what is located are equal words, not equal hashes.

Which windows may recur is told by anchors: of the GRAM-word grams of a window the one with the smallest hash. Equal windows
have equal anchors and neighbours mostly share theirs, so that counting anchors first costs a seventh of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release, table
from .filters import key_filter, may_hold, maybe
from .textbytes import NON_SPACE, Hashes, Piece, grams, pieces

#: Words of a window, of a phrase of the automata, and of a gram.
WINDOW, PHRASE, GRAM = 20, 10, 8
#: Words of a passage from one phrase to the next.
STEP = WINDOW - PHRASE + 1
#: Windows whose passages share a shard, and bytes of text that one task streams through an automaton, on average.
SHARD_WINDOWS, TASK_BYTES = 1 << 17, 16 << 20
#: Places compared at once, words on either side.
COMPARED = 1 << 15
#: First code point of the letters that stand for words in an automaton.
FIRST_CODE = 0xE000
#: Turns window hashes into keys that differ from those of anchors.
_TURN = np.uint64(0xA5A5A5A55A5A5A5A)


class Windows:
    """The windows of a piece of a batch, those that lie within one row: at (number of the first word in the piece), row
    (in the batch), hash, anchor (smallest gram)."""

    def __init__(self, p: Piece):
        self.start, self.end, row = p.spans(NON_SPACE)
        words = Hashes(p.buf).of(self.start, self.end)
        self.first = np.searchsorted(row, np.arange(p.rows))  # the first word of every row
        n = max(len(words) - WINDOW + 1, 0)
        inside = row[:n] == row[WINDOW - 1 :] if n else np.zeros(0, bool)
        self.at = np.flatnonzero(inside)
        self.row_in_piece = row[self.at]
        self.row = self.row_in_piece + p.start
        self.hash = grams(words, WINDOW)[self.at]
        self.grams = grams(words, GRAM)
        least = self.grams[:n].copy()
        for j in range(1, WINDOW - GRAM + 1):
            np.minimum(least, self.grams[j : j + n], out=least)
        self.anchor = least[self.at]

    def anchors(self) -> np.ndarray:
        """The anchor of every place that is the anchor of some window; a window that occurs twice gives two."""
        place = np.zeros(len(self.grams), bool)
        for j in range(WINDOW - GRAM + 1):
            place[self.at[self.grams[self.at + j] == self.anchor] + j] = True
        return self.grams[place]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def recurring_anchors(docs: DataFrame) -> DataFrame:
    """key of every anchor that occurs twice or more in docs (text); a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b.column(0)):
                key, n = np.unique(Windows(p).anchors(), return_counts=True)
                yield pa.RecordBatch.from_arrays([_long(key), pa.array(n > 1)], ["key", "again"])

    found = docs.select("text").mapInArrow(run, "key long, again boolean")
    each = found.groupBy("key").agg((F.sum(F.when(F.col("again"), 2).otherwise(1)) > 1).alias("again"))
    return materialize(each.where("again").select("key"), "anchors")


def recurring_windows(docs: DataFrame) -> DataFrame:
    """key, doc of every window that occurs twice or more in docs (doc, text): its hash and the smallest doc that has it; a
    written table."""
    keys = recurring_anchors(docs)
    held = docs.sparkSession.sparkContext.broadcast(key_filter(keys, keys.count()))
    release(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = held.value
        for b in batches:
            doc = b.column(0).to_numpy()
            for p in pieces(b.column(1)):
                w = Windows(p)
                some = may_hold(filter_, w.anchor)
                h, d = w.hash[some], doc[w.row[some]]
                if not len(h):
                    continue
                order = np.argsort(h)
                h, d = h[order], d[order]
                at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                many = np.diff(np.append(at, len(h))) > 1
                yield pa.RecordBatch.from_arrays([_long(h[at]), pa.array(np.minimum.reduceat(d, at)), pa.array(many)], ["key", "doc", "again"])

    found = docs.select("doc", "text").mapInArrow(run, "key long, doc long, again boolean")
    each = found.groupBy("key").agg(F.min("doc").alias("doc"), (F.sum(F.when(F.col("again"), 2).otherwise(1)) > 1).alias("again"))
    out = materialize(each.where("again").select("key", "doc"), "windows")
    held.destroy()
    return out


def passages(docs: DataFrame, windows: DataFrame, count: int) -> DataFrame:
    """shard, doc, start, body: the passages of docs (doc, text), words joined by one space; a written table.

    windows (key, doc; count rows) are the recurring ones. A passage is a maximal run of windows of a row that are
    theirs, of which the row has no earlier one. All passages of a doc are in one shard.
    """
    shards = -(-count // SHARD_WINDOWS) or 1
    mine = windows.groupBy("doc").agg(F.collect_list("key").alias("keys"))
    sources = materialize(mine, "sources")
    ids = sources.select(F.xxhash64("doc").alias("key"))
    held = docs.sparkSession.sparkContext.broadcast(key_filter(ids, sources.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            doc = b.column(0).to_pylist()
            keys, at = b.column(2).flatten().to_numpy(), np.concatenate(([0], np.cumsum(b.column(2).value_lengths().to_numpy())))
            for p in pieces(b.column(1)):
                w = Windows(p)
                blob = p.buf.tobytes()
                edges = np.searchsorted(w.row_in_piece, np.arange(p.rows + 1))
                for i in range(p.rows):
                    lo, hi = edges[i], edges[i + 1]
                    r = p.start + i
                    known = np.isin(w.hash[lo:hi].view(np.int64), keys[at[r] : at[r + 1]])
                    place = np.flatnonzero(known)
                    place = lo + np.sort(place[np.unique(w.hash[lo:hi][place], return_index=True)[1]])
                    if not len(place):
                        continue
                    cut = np.flatnonzero(np.diff(w.at[place]) != 1)
                    for a, z in zip(np.append(0, cut + 1), np.append(cut, len(place) - 1), strict=True):
                        f, t = w.at[place[a]], w.at[place[z]] + WINDOW
                        out[0].append(doc[r])
                        out[1].append(int(f - w.first[i]))
                        out[2].append(b" ".join(blob[x:y] for x, y in zip(w.start[f:t].tolist(), w.end[f:t].tolist(), strict=True)))
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "start", "body"])

    some = docs.where(maybe(held, F.xxhash64("doc"))).select("doc", "text").join(sources, "doc")
    found = some.mapInArrow(run, "doc long, start long, body string").select(F.pmod(F.xxhash64("doc"), F.lit(shards)).alias("shard"), "doc", "start", "body")
    out = materialize(found, "passages")
    release(sources)
    held.destroy()
    return out


def routes(docs: DataFrame, held: DataFrame) -> DataFrame:
    """uid, shard: the shards whose passages (held: shard, body) a row of docs (uid, text) may hold; a written table.

    A row with an anchor of a passage goes to the passage's shard. An anchor that has passages in several shards routes
    nothing, but each window with it goes where that window's passage is, so that a common gram makes no more rows than
    it has windows.
    """
    context = docs.sparkSession.sparkContext

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = b.column(0).to_numpy()
            for p in pieces(b.column(1)):
                w = Windows(p)
                yield pa.RecordBatch.from_arrays([pa.array(shard[w.row]), _long(w.anchor), _long(w.hash ^ _TURN)], ["shard", "anchor", "window"])

    kept = held.select("shard", "body").mapInArrow(parts, "shard long, anchor long, window long")
    anchors = kept.groupBy(F.col("anchor").alias("key")).agg(F.min("shard").alias("shard"), F.max("shard").alias("last"))
    anchors = materialize(anchors.select("key", "shard", F.expr("shard <> last").alias("several")), "anchors")
    several = anchors.where("several").select("key")
    every = context.broadcast(key_filter(anchors, anchors.count()))
    split = context.broadcast(key_filter(several, several.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid = b.column(0).to_numpy()
            for p in pieces(b.column(1)):
                w = Windows(p)
                at = np.flatnonzero(may_hold(every.value, w.anchor))
                if not len(at):
                    continue
                anchor, row = w.anchor[at], w.row[at]
                key = np.where(may_hold(split.value, anchor), w.hash[at] ^ _TURN, anchor)
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
                yield pa.RecordBatch.from_arrays([_long(key[new]), pa.array(uid[row[new]])], ["key", "uid"])

    # documents ask the filter which anchors have several shards, so its mistakes need their windows' keys too
    windows = kept.where(maybe(split, F.col("anchor"))).select(F.col("window").alias("key"), "shard").distinct()
    keys = anchors.where("not several").select("key", "shard").unionByName(windows)
    met = docs.select("uid", "text").mapInArrow(run, "key long, uid long").join(keys, "key")
    out = materialize(met.select("uid", "shard").distinct(), "routes")
    release(anchors)
    every.destroy()
    split.destroy()
    return out


class Shard:
    """The passages of a shard, and the automaton over their phrases."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.words: list[np.ndarray] = [np.full(WINDOW, -1, np.int32)]
        self.meta: list[tuple[int, int, int]] = []  # a passage's doc, its first word's number there, and where its words begin here
        self.length = WINDOW
        self.automaton = None

    def add(self, doc: int, start: int, body: bytes) -> None:
        numbers = self.numbers
        found = [numbers.setdefault(x, len(numbers) + 1) for x in body.split(b" ")]
        self.meta.append((doc, start, self.length))
        self.words += [np.array(found, np.int32), np.full(WINDOW, -1, np.int32)]  # no window goes past a passage's end
        self.length += len(found) + WINDOW

    def compile(self) -> None:
        self.text = np.concatenate(self.words)
        self.words = []
        self.docs, self.starts, self.begins = (np.array(x, np.int64) for x in zip(*self.meta, strict=True)) if self.meta else [np.zeros(0, np.int64)] * 3
        # two letters a word, so that no node of the automaton, the root least, has many children to look through
        self.base = 1 << ((len(self.numbers) + 1).bit_length() + 1) // 2
        codes = self._codes(self.text)
        ends = np.append(self.begins[1:] - WINDOW, self.length - WINDOW)
        n = (ends - self.begins - PHRASE) // STEP + 1
        first = np.cumsum(n) - n
        place = np.repeat(self.begins - first * STEP, n) + np.arange(int(n.sum())) * STEP
        by: dict[str, list[int]] = {}
        for q in place.tolist():
            by.setdefault(codes[2 * q : 2 * (q + PHRASE)], []).append(q)
        self.places = np.array([q for x in by.values() for q in x], np.int64)
        self.many = np.array([len(x) for x in by.values()], np.int64)
        self.from_ = np.cumsum(self.many) - self.many
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, phrase in enumerate(by):
            self.automaton.add_word(phrase, i)
        self.automaton.make_automaton()

    def _codes(self, numbers: np.ndarray) -> str:
        """Two letters a word, of an alphabet for first and one for second letters."""
        two = np.empty((len(numbers), 2), "<u4")
        two[:, 0] = FIRST_CODE + numbers // self.base % self.base
        two[:, 1] = FIRST_CODE + self.base + numbers % self.base
        return two.tobytes().decode("utf-32-le")

    def later(self, doc: int, words: list[bytes]) -> list[int]:
        """Word ranges (from, to, from, to, ...) of the text that windows cover whose words a passage has at a smaller
        doc or in the same doc at a smaller place; ranges ascend and don't meet."""
        text = np.full(len(words) + 2 * WINDOW, -2, np.int32)
        text[WINDOW:-WINDOW] = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int32, len(words))
        hits = np.array(list(self.automaton.iter(self._codes(text[WINDOW:-WINDOW]))), np.int64).reshape(-1, 2)
        if not len(hits):
            return []
        at, phrase = (hits[:, 0] + 1) // 2 - PHRASE, hits[:, 1]
        many = self.many[phrase]
        upto = np.cumsum(many)
        change = np.zeros(len(words) + 1, np.int64)
        for lo in range(0, int(upto[-1]), COMPARED):
            pair = np.arange(lo, min(lo + COMPARED, int(upto[-1])))
            hit = np.searchsorted(upto, pair, "right")
            q = self.places[self.from_[phrase[hit]] + pair - (upto[hit] - many[hit])]
            pos = at[hit]
            passage = np.searchsorted(self.begins, q, "right") - 1
            a, source = self.starts[passage] + q - self.begins[passage], self.docs[passage]
            earlier = (source < doc) | ((source == doc) & (a < pos))
            q, pos = q[earlier], pos[earlier]
            f, t = _extents(self.text, q, text, pos + WINDOW)
            fine = t - f >= WINDOW
            np.add.at(change, pos[fine] + f[fine], 1)
            np.add.at(change, pos[fine] + t[fine], -1)
        edge = np.diff(np.concatenate(([0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0])))
        return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)]).reshape(-1).tolist()


def _extents(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of phrases at x[i] and y[j], how far the same words reach: from (0 or less) and to, seen from the phrase's first
    word; no further than the windows that hold the phrase."""
    left = np.arange(-1, -(WINDOW - PHRASE) - 1, -1)
    right = np.arange(WINDOW)
    f = np.logical_and.accumulate(x[i[:, None] + left] == y[j[:, None] + left], axis=1).sum(1)
    t = np.logical_and.accumulate(x[i[:, None] + right] == y[j[:, None] + right], axis=1).sum(1)
    return -f, t


def located(docs: DataFrame, held: DataFrame, ways: DataFrame) -> DataFrame:
    """uid, spans: word ranges of docs (uid, doc, text) that windows cover which a passage of held (passages()) has at a
    smaller (doc, place); only rows with any. ways (routes()) says which shards a row streams through; a written table.

    A shard's text may be dealt over several tasks, each of which compiles its automaton; there are as many as its
    text fills.
    """
    ids = ways.select(F.col("uid").alias("key")).distinct()
    filter_ = docs.sparkSession.sparkContext.broadcast(key_filter(ids, ids.count()))
    some = docs.where(maybe(filter_, F.col("uid"))).groupBy("uid").agg(F.first("doc").alias("doc"), F.first("text").alias("text"))
    sent = materialize(some.join(ways, "uid"), "sent")
    tasks = sent.groupBy("shard").agg(F.expr(f"cast(ceil(sum(octet_length(text)) / {TASK_BYTES}) as int)").alias("tasks"))
    tasks = materialize(tasks, "tasks")
    part = F.when(F.col("tasks") > 1, F.pmod(F.xxhash64("uid"), F.col("tasks"))).otherwise(0).cast("int").alias("part")
    none = F.lit(None).cast("long")
    texts = sent.join(tasks, "shard").select("shard", part, F.lit(1).alias("kind"), "uid", "doc", none.alias("start"), F.col("text").alias("body"))
    copies = F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("part")
    automata = held.join(tasks, "shard").select("shard", copies, F.lit(0).alias("kind"), none.alias("uid"), "doc", "start", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard = None, Shard()
        for b in batches:
            uid, spans = [], []
            for s, part, kind, u, doc, start, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if known != (s, part):
                    known, shard = (s, part), Shard()
                if kind == 0:
                    shard.add(doc, start, body)
                    continue
                if shard.automaton is None:
                    shard.compile()
                found = shard.later(doc, _words(body))
                if found:
                    uid.append(u)
                    spans.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], ["uid", "spans"])

    both = automata.unionByName(texts).withColumn("body", F.col("body").cast("binary"))
    dealt = both.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    found = dealt.mapInArrow(run, "uid long, spans array<int>")
    out = materialize(found.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    for x in (sent, tasks):
        release(x)
    filter_.destroy()
    return out


def _words(text: bytes) -> list[bytes]:
    return text.split()  # for bytes: \x20 and \x09-\x0D


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, spans of every row of docs: word ranges (from, to, from, to, ...; null if none; those of different
    shards may overlap) that a window covers whose words also start earlier.

    A word is [^\\x20\\x09-\\x0D]+, a window WINDOW of them in a row; earlier is a smaller doc_id, or in the same one a
    smaller word number. Rows that share a doc_id count as one document, so equal rows keep and lose the same; every
    null doc_id counts as one of its own, in an order of their texts behind the others. A null text has no words. An
    empty table gives an empty one; other columns are ignored.
    """
    id_ = F.col(id_col).cast("long")
    own = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text_col), 2)
    slim = docs.select(id_.alias("doc_id"), F.coalesce(id_, own).alias("doc"), F.col(text_col).alias("text"))
    slim = slim.withColumn("uid", F.xxhash64("doc", F.coalesce("text", F.lit(""))))
    windows = recurring_windows(slim)
    held = passages(slim, windows, windows.count())
    release(windows)
    ways = routes(slim, held)
    spans = located(slim, held, ways)
    release(held)
    release(ways)
    keys = spans.select(F.col("uid").alias("key"))
    may = slim.withColumn("_may", maybe(slim.sparkSession.sparkContext.broadcast(key_filter(keys, spans.count())), F.col("uid")))
    with_any = may.where("_may").join(spans, "uid", "left").select("doc_id", "text", "spans")
    return with_any.unionByName(may.where("not _may").select("doc_id", "text", F.lit(None).cast("array<int>").alias("spans")))


def _kept(text: str | None, spans: list[int] | None) -> tuple[int, int, list[bytes]]:
    words = _words((text or "").encode())
    if not spans:
        return len(words), 0, words
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, spans[::2], 1)
    np.add.at(gone, spans[1::2], -1)
    stays = np.cumsum(gone)[:-1] == 0
    return len(words), len(words) - int(stays.sum()), [x for x, k in zip(words, stays.tolist(), strict=True) if k]


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text of every row of docs: the words that repeated_passages() leaves, joined by one space; a text that loses
    nothing stays as it is, a null one null."""

    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([b" ".join(_kept(t, s)[2]).decode() if s else t for t, s in rows], pa.string())

    return repeated_passages(docs, id_col, text_col).select("doc_id", cut("text", "spans").alias("text"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, sha = [], [], []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words, removed, kept = _kept(text, spans)
            n.append(words)
            gone.append(removed)
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        columns = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS MATERIALIZED (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1))) AS i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM words),
firsts AS (SELECT h, min((doc_id, i)) AS f FROM starts GROUP BY h HAVING count(*) > 1),
later AS (SELECT s.doc_id, s.i FROM starts s JOIN firsts USING (h) WHERE f < (s.doc_id, s.i)),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS g FROM later GROUP BY doc_id),
kept AS (
  SELECT doc_id, w, g, CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT g_map[j]) END AS k
  FROM (SELECT doc_id, w, g, CASE WHEN g IS NULL THEN NULL ELSE list_transform(range(1, len(w) + 1), lambda j: list_contains(g, j)) END AS g_map
        FROM words LEFT JOIN gone USING (doc_id)))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
