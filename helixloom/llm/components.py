"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Defined cases: an edge with a null end links nothing; loops and repeated edges change nothing; an empty table gives no rows; other columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import cut


def _sum(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
    return r["n"], r["h"] or 0


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # cut, so that the join can split a star's centre
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these. Edges go from larger u to smaller v."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node long, root long (the least node of its component) for every node of `edges` (u long, v long); a node without a link isn't there.

    Links stay in the cluster; the driver sees a count and a checksum a round. Rounds grow with the logarithm of the nodes.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _sum(now)
    while seen[0]:
        now = cut(_small(_large(now)))
        if (got := _sum(now)) == seen:
            break
        seen = got
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
