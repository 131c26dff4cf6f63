"""WARC archives: writing records, and reading them back by verifying the chain of record boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha1

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, new_path, release, table

MAGIC = "WARC/1.0\r\n"
#: Payloads of fewer bytes are always stored whole.
LEAST_REVISIT = 1000
#: Repeated payloads up to which their table is broadcast (some 100 bytes each); beyond that the pages are shuffled.
BROADCAST_GROUPS = 100_000
#: Bytes of an archive's stretch by which chunks meet the payloads that they are parts of.
STRETCH = 1 << 16
_FIELD = re.compile(rb"(?:^|\r\n)([!-9;-~]+): *([^\r\n]*)")


def records(pages: DataFrame) -> DataFrame:
    """page_id, record for every row of pages (page_id, url, html; others are ignored, whatever their names).

    Of rows with equal payloads of LEAST_REVISIT bytes or more, that with the largest page_id (null is the smallest;
    of rows that repeat it, one) is a response, the others revisit it. All else is a response. A null url or html counts
    as empty; no pages give no records.
    """
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    p = p.withColumns({"n": F.octet_length("html").cast("long"), "digest": F.sha1("html")})
    each = p.where(F.col("n") >= LEAST_REVISIT).groupBy("digest", "n", "page_id").agg(F.count("*").alias("ties"))
    top = each.groupBy(F.col("digest").alias("_digest"), F.col("n").alias("_n")).agg(F.max(F.struct("page_id", "ties")).alias("_top"), F.sum("ties").alias("_many"))
    top = materialize(top.where("_many > 1").drop("_many"), "repeated")
    few = top.count() <= BROADCAST_GROUPS
    joined = p.join(F.broadcast(top) if few else top, (F.col("digest") == F.col("_digest")) & (F.col("n") == F.col("_n")), "left")
    first = F.col("_top").isNotNull() & F.col("_top.page_id").eqNullSafe(F.col("page_id"))
    tied = F.coalesce(first & (F.col("_top.ties") > 1), F.lit(False))
    number = F.monotonically_increasing_id().cast("string")
    plain = joined.where(~tied).select("*", F.when(first, "first").otherwise(number).alias("own"))
    out = plain.select(*_record())
    if top.where("_top.ties > 1").isEmpty():
        return out
    # rows that repeat the largest page_id: a written table, so that one of them is the response whatever is scanned how
    same = materialize(joined.where(tied).withColumn("own", F.concat(F.lit("t"), number)), "tied")
    picked = materialize(same.groupBy("digest", "n").agg(F.max("own").alias("_own")), "picked")
    few = picked.count() <= BROADCAST_GROUPS
    one = same.join(F.broadcast(picked) if few else picked, ["digest", "n"])
    return out.union(one.withColumn("own", F.when(F.col("own") == F.col("_own"), "first").otherwise(F.col("own"))).select(*_record()))


def _record() -> list[Column]:
    """page_id and record from a row's page_id, url, html, n, digest, own (first: the response of repeated payloads, else
    the row's number) and _top (of repeated payloads)."""
    revisit = F.col("_top").isNotNull() & (F.col("own") != "first")

    def text(x: str) -> Column:
        return F.coalesce(F.col(x).cast("string"), F.lit(""))

    response = F.concat(F.lit("<urn:page:"), text("_top.page_id"), F.lit(":"), F.col("digest"), F.lit(">"))
    own = F.when(F.col("own") == "first", response).otherwise(F.concat(F.lit("<urn:page:"), text("page_id"), F.lit(":"), F.col("own"), F.lit(">")))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), own,
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nX-Page-ID: "), text("page_id"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), response, F.lit("\r\nX-Refers-To-Page-ID: "), text("_top.page_id"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, 0).otherwise(F.col("n")).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return [F.col("page_id"), F.concat(head, F.when(revisit, "").otherwise(F.col("html")), F.lit("\r\n\r\n")).alias("record")]


def write(pages: DataFrame, path: str) -> None:
    """One uncompressed archive for each output partition. A record ends with a newline, which Spark's writer adds."""
    records(pages).select(F.expr("substring(record, 1, length(record) - 1)").alias("value")).write.option("lineSep", "\n").text(path)


def _header(body: bytes) -> tuple[dict[bytes, bytes], int] | None:
    end = body.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(body[:end])}
    if b"warc-type" not in fields or not fields.get(b"content-length", b"").isdigit():
        return None
    return fields, end + 4


_CANDIDATE = "file string, block long, at long, upto long, out long, size long, body_at long, rid string, page string, type string, refers string, ref_page string, digest string"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place in the archives below path that looks like a record.

    Text splits are read at the magic, so that a task knows each place's offset from its split's first byte. at is
    where the record begins, upto where its successor does by its own length, out where the chain from it leaves the
    split; size the payload's bytes, body_at where it begins, digest its SHA-1, or null if a magic in it cut it.
    One row with a null at for each split has its length in upto.
    """
    chunks = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at, held = None, 0, []
        for b in batches:
            for file, block, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if where != (file, block):
                    if where:
                        yield _split(where, at, held)
                    where, at, held = (file, block), 0, []
                found = _header(body)
                if found:
                    f, h = found
                    size = int(f[b"content-length"])
                    begin = at - len(MAGIC)
                    text = {k: f.get(n, b"").decode("utf-8", "replace") for k, n in _NAMES.items()}
                    digest = sha1(body[h : h + size]).hexdigest() if len(body) >= h + size else None
                    held.append((begin, at + h + size + 4, size, at + h, digest, text))
                at += len(body) + len(MAGIC)
        if where:
            yield _split(where, at, held)

    return chunks.mapInArrow(run, _CANDIDATE)


_NAMES = {"rid": b"warc-record-id", "page": b"x-page-id", "type": b"warc-type", "refers": b"warc-refers-to", "ref_page": b"x-refers-to-page-id"}


def _split(where: tuple, length: int, held: list) -> pa.RecordBatch:
    leaves: dict[int, int] = {}
    for begin, upto, *_ in reversed(held):
        leaves[begin] = leaves.get(upto, upto)
    rows = {
        "file": [where[0]] * (len(held) + 1), "block": [where[1]] * (len(held) + 1),
        "at": [x[0] for x in held] + [None], "upto": [x[1] for x in held] + [length], "out": [leaves[x[0]] for x in held] + [None],
        "size": [x[2] for x in held] + [None], "body_at": [x[3] for x in held] + [None],
        **{k: [x[5][k] for x in held] + [None] for k in _NAMES}, "digest": [x[4] for x in held] + [None],
    }
    kinds = {"file": pa.string(), **dict.fromkeys(_NAMES, pa.string()), "digest": pa.string()}
    columns = ["file", "block", "at", "upto", "out", "size", "body_at", "rid", "page", "type", "refers", "ref_page", "digest"]
    return pa.RecordBatch.from_arrays([pa.array(rows[c], kinds.get(c, pa.int64())) for c in columns], columns)


def _bases(splits: DataFrame) -> DataFrame:
    """file, block, base: where each split of splits (file, block, length) begins."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("file", "block", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("base"))


def placed(found: DataFrame) -> DataFrame:
    """candidates() with offsets from the start of their files: a split begins where those before it end."""
    splits = found.where("at is null").groupBy("file", "block").agg(F.sum("upto").alias("length"))
    base = _bases(splits)
    moved = {c: F.col(c) + F.col("base") for c in ("at", "upto", "out", "body_at")}
    return found.where("at is not null").join(base, ["file", "block"]).withColumns(moved).drop("base")


def reachable(found: DataFrame) -> DataFrame:
    """The rows of placed() that a chain of successors reaches from the start of their file.

    Pointer jumping over the places where chains enter splits: a round marks what the marked ones point to and doubles
    every pointer, so rounds grow with the logarithm of a file's splits. Then every split follows its own chain.
    """
    nodes = materialize(found.select("file", "at", F.col("out").alias("jump"), (F.col("at") == 0).alias("hit")), "jumps")
    hits = -1
    while True:
        marks = nodes.where("hit").select(F.col("file").alias("_f"), F.col("jump").alias("_m")).distinct()
        ahead = nodes.select(F.col("file").alias("_g"), F.col("at").alias("_a"), F.col("jump").alias("_j"))
        nodes = materialize(
            nodes.join(marks, (F.col("file") == F.col("_f")) & (F.col("at") == F.col("_m")), "left")
            .join(ahead, (F.col("file") == F.col("_g")) & (F.col("jump") == F.col("_a")), "left")
            .select("file", "at", F.coalesce("_j", "jump").alias("jump"), (F.col("hit") | F.col("_m").isNotNull()).alias("hit")),
            "jumps",
        )
        now = nodes.where("hit").count()
        if now == hits:
            break
        hits = now
    entries = nodes.where("hit").select(F.col("file").alias("_f"), F.col("at").alias("_a"))
    marked = found.select("file", "block", "at", "upto").join(entries, (F.col("file") == F.col("_f")) & (F.col("at") == F.col("_a")), "left")

    def follow(split: pd.DataFrame) -> pd.DataFrame:
        after = dict(zip(split["at"].tolist(), split["upto"].tolist(), strict=True))
        out = []
        for at in sorted(split.loc[split["entry"], "at"].tolist()):
            while at in after:
                out.append(at)
                at = after.pop(at)
        return pd.DataFrame({"file": split["file"].iloc[0], "at": out}).astype({"file": str, "at": "int64"})

    chain = (
        marked.select("file", "block", "at", "upto", F.col("_a").isNotNull().alias("entry")).groupBy("file", "block").applyInPandas(follow, "file string, at long")
    )
    return found.join(chain, ["file", "at"], "left_semi")


def _cut_payloads(spark: SparkSession, path: str, cut: DataFrame) -> DataFrame:
    """file, at, digest of records (file, at, body_at, size) whose payload holds the magic: their chunks, put together."""
    chunks = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )
    wanted = {r["file"] for r in cut.select("file").distinct().limit(1000).toLocalIterator()}
    if len(wanted) < 1000:
        chunks = chunks.where(F.col("file").isin(*wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = None, 0
        for b in batches:
            file, block, body = (c.to_pylist() for c in b.columns)
            begin = []
            for f, k, x in zip(file, block, body, strict=True):
                if where != (f, k):
                    where, at = (f, k), 0
                begin.append(at)
                at += len(x) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(begin, pa.int64()), b.columns[2]], ["file", "block", "at", "value"])

    parts = chunks.mapInArrow(run, "file string, block long, at long, value binary")
    lengths = parts.groupBy("file", "block").agg(F.max(F.col("at") + F.octet_length("value") + len(MAGIC)).alias("length"))
    parts = parts.join(_bases(lengths), ["file", "block"]).select("file", (F.col("at") + F.col("base")).alias("from"), "value")
    # a chunk and a payload that overlap are joined in the first stretch of the file that holds some of both
    reach = F.sequence(F.floor(F.col("from") / STRETCH), F.floor((F.col("from") + F.octet_length("value") + len(MAGIC)) / STRETCH))
    parts = parts.withColumn("stretch", F.explode(reach))
    span = F.sequence(F.floor(F.col("body_at") / STRETCH), F.floor((F.col("body_at") + F.col("size")) / STRETCH))
    c = cut.select(F.col("file").alias("_f"), F.col("at").alias("_at"), "body_at", "size", F.explode(span).alias("_s"))
    overlap = (F.col("from") < F.col("body_at") + F.col("size")) & (F.col("from") + F.octet_length("value") + len(MAGIC) > F.col("body_at"))
    once = F.col("stretch") == F.floor(F.greatest("from", "body_at") / STRETCH)
    met = parts.join(c, (F.col("file") == F.col("_f")) & (F.col("stretch") == F.col("_s")) & overlap & once)
    whole = met.groupBy("_f", "_at", "body_at", "size").agg(F.array_sort(F.collect_list(F.struct("from", "value"))).alias("p"))

    @F.arrow_udf(T.StringType())
    def digest(p: pa.Array, body_at: pa.Array, size: pa.Array) -> pa.Array:
        out = []
        for x, at, n in zip(p.to_pylist(), body_at.to_pylist(), size.to_pylist(), strict=True):
            blob = b"".join(y["value"] + MAGIC.encode() for y in x)
            out.append(sha1(blob[at - x[0]["from"] :][:n]).hexdigest())
        return pa.array(out, pa.string())

    return whole.select(F.col("_f").alias("file"), F.col("_at").alias("at"), digest("p", "body_at", "size").alias("digest"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, rid, type, payload_bytes, payload_digest (both of the full payload, that of a revisit is its
    response's), refers_to for every reachable record of the archives below path."""
    found = materialize(placed(materialize(candidates(spark, path), "candidates")), "placed")
    kept = materialize(reachable(found), "records")
    cut = kept.where("digest is null")
    if not cut.isEmpty():
        whole = _cut_payloads(spark, path, cut).withColumnRenamed("digest", "_d")
        kept = materialize(kept.join(whole, ["file", "at"], "left").withColumn("digest", F.coalesce("digest", "_d")).drop("_d"), "records")
    own = kept.where("type = 'response'").select(F.col("rid").alias("_rid"), F.col("size").alias("_size"), F.col("digest").alias("_digest"))
    number = {"page_id": F.expr("try_cast(page as bigint)"), "refers_to": F.expr("try_cast(ref_page as bigint)")}
    joined = kept.withColumns(number).join(own, F.when(F.col("type") == "revisit", F.col("refers")).otherwise(F.col("rid")) == F.col("_rid"), "left")
    return joined.select("page_id", "rid", "type", F.col("_size").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), F.when(F.col("type") == "revisit", F.col("refers_to")).alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back; an empty table gives an empty one."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    return read(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
t AS (SELECT html, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN t ON p.html = t.html
"""
