"""Connected components of a distributed edge table: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """Union-find over links.

    edges: columns u, v of one orderable type; order, repeats and loops don't matter, rows with a null are no link.
    Returns node, root for every node that is not the smallest of its component (root is the smallest). No links
    give an empty table. Rounds grow with the logarithm of a component's size. A node with very many links only
    meets the others in joins (which Spark splits when a key is hot) and in aggregates that combine before they
    shuffle. Every round is a written table.
    """
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while not _settled(now):
        turned = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = now.union(turned).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = turned.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = materialize(small, "edges")
        release(now)
        now = after
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._plumbline_path = now._plumbline_path
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node without any."""
    roots = edges.select(F.col("v").alias("u")).distinct()
    several = edges.groupBy("u").count().where("count > 1").select("u")
    return edges.join(roots, "u", "left_semi").select("u").union(several).isEmpty()
