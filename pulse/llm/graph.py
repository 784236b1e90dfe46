"""Connected components of an edge list, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _is_settled(pairs: DataFrame) -> bool:
    """Whether every node points to one root, and roots to none."""
    ends = (pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            .union(pairs.select("v", F.lit(0), F.lit(1))))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return odd.filter((F.col("up") > 1) | (F.col("up") + F.col("down") > 1)).limit(1).count() == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that an edge joins to another; root is the
    least node that can be reached. Alternates the large-star and small-star
    rounds, which shorten every path by a factor, so the rounds grow with the
    logarithm of the longest path. Each round groups by node with partial
    aggregation and joins the least neighbour back; no group is held whole.
    Repeated edges are allowed; loops and edges with a null end are dropped."""
    u, v = F.greatest(a, b), F.least(a, b)
    pairs = common.cut(edges.filter(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct())
    while not _is_settled(pairs):
        # Large star: a node's larger neighbours point to its least neighbour.
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node's smaller neighbours, and itself, point to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        nearer = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = common.cut(nearer.union(least.select("u", "m")).distinct())
    return common.cut(pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
                      .union(pairs.select("v", "v").distinct()))
