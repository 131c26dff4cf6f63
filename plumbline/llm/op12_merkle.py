"""Merkle manifest of a table: a parent keeps its children's hashes end to end, and leaves prove themselves by them.

Every group (a language) is a tree over its rows, and the groups' roots are the leaves of one more tree. Parents are
written tables of preimages, so that a proof is a join upwards: a leaf takes the preimages of its ancestors, cuts its own
slot out of each for its siblings, and puts another hash in that slot to fold a changed row. All of it is DataFrame work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, release, table

#: Children of a parent, and characters of a hash.
FANOUT, SLOT = 8, 64
#: Fields of a document's leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of the fields end to end: "-" for a null, else the length in UTF-8 bytes, ":" and the value."""
    parts = []
    for f in fields:
        x = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """A string that orders as the group does by UTF-8 bytes, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (a written table with a column g) with i, their number from 0 within g by order, and m, the rows of g.

    Rows are range-partitioned by g and order, tasks count what they hold of every group, and a row's number is its
    place in its task behind what earlier tasks hold. No group meets in one task. The result is a written table.
    """
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    placed = materialize(dealt.withColumns({"task": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "placed")
    held = placed.groupBy("g", "task").agg(F.count("*").alias("n"), F.min("place").alias("from"))
    before = Window.partitionBy("g").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("g")
    held = held.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("from"), "m": F.sum("n").over(all_)})
    out = placed.join(held.select("g", "task", "base", "m"), ["g", "task"]).withColumn("i", F.col("place") + F.col("base"))
    out = materialize(out.drop("task", "place", "base"), "numbered")
    release(placed)
    return out


def parents(nodes: DataFrame) -> DataFrame:
    """g, i, pre, h, m of the level above nodes (g, i, h, m): pre is the children's hashes end to end, h its hash.

    Every FANOUT consecutive nodes have a parent, and the last ones of a group too, even one alone; a group of one node
    has none.
    """
    up = nodes.where("m > 1").groupBy("g", F.expr(f"i div {FANOUT}").alias("i"))
    pre = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]))
    found = up.agg(pre.alias("pre"), F.expr(f"(first(m) + {FANOUT - 1}) div {FANOUT}").alias("m"))
    return found.select("g", "i", "pre", F.sha2("pre", 256).alias("h"), "m")


@dataclass
class Tree:
    """Trees over the nodes of every group. leaves: g, i, h, m; levels: parents() from the lowest up; roots: g, h."""

    leaves: DataFrame
    levels: list[DataFrame]
    roots: DataFrame

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """leaves with path: their ancestors' preimages from below, each with the slot that the one below it has.

        above (g, path and others): what a group's root goes on with; the others are handed down. A node joins its parent
        alone, which has its own path.
        """
        up, handed = None, [c for c in above.columns if c not in ("g", "path")] if above is not None else []
        for nodes in [*reversed(self.levels), self.leaves]:
            slot = F.expr(f"cast(i % {FANOUT} as int)").alias("slot")
            top = nodes.where("m = 1")
            if above is None:
                top = top.withColumn("path", F.expr("cast(array() as array<struct<pre:string,slot:int>>)"))
            else:
                top = top.join(above, "g")
            if up is not None:
                parent = up.select("g", F.col("i").alias("_up"), F.col("pre").alias("_pre"), F.col("path").alias("_path"), *handed)
                inner = nodes.where("m > 1").withColumn("_up", F.expr(f"i div {FANOUT}")).join(parent, ["g", "_up"])
                path = F.concat(F.array(F.struct(F.col("_pre").alias("pre"), slot)), F.col("_path"))
                top = top.unionByName(inner.withColumn("path", path).drop("_up", "_pre", "_path"))
            up = top
        return up


def tree(leaves: DataFrame) -> Tree:
    """The trees over leaves, a written table of g, i (from 0 in every group), h, m (rows of the group) and others."""
    widest = leaves.agg(F.max("m")).first()[0] or 0
    levels, now = [], leaves
    while widest > 1:
        now = materialize(parents(now.select("g", "i", "h", "m")), "level")
        levels.append(now)
        widest = -(-widest // FANOUT)
    roots = leaves.where("m = 1").select("g", "h")
    for x in levels:
        roots = roots.unionByName(x.where("m = 1").select("g", "h"))
    return Tree(leaves, levels, roots)


@dataclass
class Manifest:
    """groups: the trees of the groups; top: the tree over their roots; root: its root, None if there is no row."""

    groups: Tree
    top: Tree
    root: str | None

    def proofs(self) -> DataFrame:
        """The leaves with subroot and path: from a leaf to its group's root and on to the root."""
        above = self.top.paths().select(F.col("member").alias("g"), F.col("h").alias("subroot"), "path")
        return self.groups.paths(above)

    def release(self) -> None:
        """Delete the written tables; proofs() can't be read any more."""
        for x in (self.groups, self.top):
            for t in (x.leaves, *x.levels):
                release(t)


def manifest(leaves: DataFrame, order: list[str]) -> Manifest:
    """The manifest of leaves: g (a group_key()), h (a leaf_hash()), the columns of order, by which the rows of a group
    ascend (null first, then by h; rows that share both are interchangeable), and any others, which pass."""
    rows = materialize(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    groups = tree(numbered(rows, [*order, "h", "_row"]))
    release(rows)
    roots = materialize(groups.roots.select(F.lit("").alias("g"), F.col("g").alias("member"), "h"), "roots")
    top = tree(numbered(roots, ["member"]))
    release(roots)
    root = top.roots.first()
    return Manifest(groups, top, root["h"] if root else None)


def siblings(path: Column) -> Column:
    """The hashes of the path's siblings end to end: every preimage without its own slot."""
    return F.concat_ws("", F.transform(path, lambda p: F.concat(_left(p), _right(p))))


def fold(path: Column, leaf: Column) -> Column:
    """The root that leaf leads to: its hash put into its slot of every preimage in turn."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(_left(p), h, _right(p)), 256))


def _left(p: Column) -> Column:
    return F.substring(p["pre"], F.lit(1), p["slot"] * SLOT)


def _right(p: Column) -> Column:
    return F.substring(p["pre"], p["slot"] * SLOT + SLOT + 1, F.lit(FANOUT * SLOT))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def document_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, path, changed_leaf of every row of docs (doc_id, source, lang, n_chars, text; others
    are ignored, whatever their names).

    The rows of a lang ascend by doc_id (null first, then by leaf), so rows that repeat one have the same leaf and proofs
    of their own. Where 3 divides the CRC-32 of the decimal doc_id, changed_leaf is that of the text with A-Z in lower
    case; else, for a null doc_id and for a null text it is the leaf. An empty table gives an empty one.
    """
    d = docs.select(*(F.col(c) for c in FIELDS))
    d = d.withColumns({"doc_id": F.col("doc_id").cast("long"), "n_chars": F.col("n_chars").cast("long")})
    lower = F.translate("text", _UPPER, _UPPER.lower())
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(hit & (F.col("text") != lower), leaf_hash([*(F.col(c) for c in FIELDS[:-1]), lower]))
    leaves = d.select("doc_id", group_key(F.col("lang")).alias("g"), leaf_hash([F.col(c) for c in FIELDS]).alias("h"), changed.alias("changed"))
    m = manifest(leaves, ["doc_id"])
    return m.proofs().select("doc_id", F.col("h").alias("leaf"), "subroot", F.lit(m.root).cast("string").alias("root"), "path", F.coalesce("changed", "h").alias("changed_leaf"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_proofs(table(spark, sf_dir, "documents"))
    found = found.withColumns({"proof_sha256": F.sha2(siblings(F.col("path")), 256), "folded_root": fold(F.col("path"), F.col("changed_leaf"))})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({x}))::VARCHAR || ':' || {x}, '-')" for x in fields) + ")"


ORACLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_sql_leaf("text")} AS leaf,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
             lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT) % 3 = 0 AS hit,
         {_sql_leaf(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} AS changed
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM leaves),
nodes(g, k, i, h, pre, m) AS (
  SELECT g, 0, i, leaf, NULL::VARCHAR, m FROM placed
  UNION ALL
  SELECT g, k + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), string_agg(h, '' ORDER BY i), (m + 7) // 8
  FROM nodes WHERE m > 1 GROUP BY g, k, i // 8, m),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS r FROM nodes WHERE m = 1),
tops(k, i, h, pre, m) AS (
  SELECT 0, r, subroot, NULL::VARCHAR, count(*) OVER () FROM subroots
  UNION ALL
  SELECT k + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), string_agg(h, '' ORDER BY i), (m + 7) // 8
  FROM tops WHERE m > 1 GROUP BY k, i // 8, m),
own(doc_id, leaf, g, k, i, row, sib, folded) AS (
  SELECT doc_id, leaf, g, 0, i, i, '', CASE WHEN hit THEN changed ELSE leaf END FROM placed
  UNION ALL
  SELECT doc_id, leaf, o.g, o.k + 1, o.i // 8, row, sib || left(pre, 64 * (o.i % 8)) || substr(pre, 64 * (o.i % 8) + 65),
         sha256(left(pre, 64 * (o.i % 8)) || folded || substr(pre, 64 * (o.i % 8) + 65))
  FROM own o JOIN nodes n ON n.g = o.g AND n.k = o.k + 1 AND n.i = o.i // 8),
grown AS (SELECT * FROM own QUALIFY k = max(k) OVER (PARTITION BY g, row)),
up(doc_id, leaf, subroot, row, g, k, i, sib, folded) AS (
  SELECT doc_id, leaf, subroot, row, g, 0, r, sib, folded FROM grown JOIN subroots USING (g)
  UNION ALL
  SELECT doc_id, leaf, subroot, row, g, u.k + 1, u.i // 8, sib || left(pre, 64 * (u.i % 8)) || substr(pre, 64 * (u.i % 8) + 65),
         sha256(left(pre, 64 * (u.i % 8)) || folded || substr(pre, 64 * (u.i % 8) + 65))
  FROM up u JOIN tops t ON t.k = u.k + 1 AND t.i = u.i // 8)
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM (SELECT * FROM up QUALIFY k = max(k) OVER ()), (SELECT h AS root FROM tops WHERE m = 1)
"""
