"""Connected components of a stored edge table, by alternating star contraction.

Every step is a join and an aggregation with partial sums; no neighbour list is collected,
and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    )


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest one around: the larger ones, or the smaller and the node."""
    near = _both(edges)
    if not large:
        near = near.where("b < a")
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = near.join(least, "a")
    if large:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))
    )


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node that has none itself."""
    seen = edges.select(F.col("a").alias("node"), F.lit(1).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("down"))
    )
    sums = seen.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return sums.where((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("least") == 0))).isEmpty()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge (a, b)."""
    edges = edges.where("a <> b").select("a", "b")
    while True:
        starred = _star(edges, large=True).where("a <> b")
        edges = stored(_star(starred, large=False).where("a <> b").distinct(), label)
        if _settled(edges):
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("b").alias("component")))


def joined_components(of: DataFrame, links: DataFrame, label: str = "components") -> DataFrame:
    """The components ``of`` after more links (a, b): only those that these meet are followed again."""

    def named(end: str) -> DataFrame:
        return of.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))

    met = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")
    )
    moved = components(stored(met.distinct(), f"{label}-met"), label).select(
        F.col("node").alias("was"), F.col("component").alias("now")
    )
    kept = of.join(moved, of.component == moved.was, "left").select(
        "node", F.coalesce("now", "component").alias("component")
    )
    new = moved.join(of, moved.was == of.node, "left_anti").select(
        F.col("was").alias("node"), F.col("now").alias("component")
    )
    return stored(kept.unionByName(new), f"{label}-all")
