"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, save

MAX_ROUNDS = 64


def _settled(edges: DataFrame) -> bool:
    """Whether each larger end has one edge and is no smaller end: then every component is a star."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.bool_or(F.expr("up + down > 1 AND up > 0"))).first()[0]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge to another node; component is the smallest node reachable.

    Edges are undirected. Null ends and self-loops join nothing; repeated edges count once. A round first hangs each
    node's larger neighbours on the smallest node around it, then its smaller ones. Minima are pre-aggregated in the
    map tasks, so a node with very many edges is never gathered in one task. Each round is written to the shared
    folder. The work ends when every component is a star around its smallest node.
    """
    ends = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u > v and v is not null").distinct()
    stars = save(ends, "components")
    for _ in range(MAX_ROUNDS):
        if _settled(stars):
            break
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        moved = large.join(least, F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = save(moved.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), "components")
        discard(stars)
        stars = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    hung = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return hung.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
