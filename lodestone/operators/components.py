"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.storage import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """node, component (its smallest node) for every node that an edge between different nodes names.

    Each round is written to the shared folder and read again, so lineage stays
    short; the number of rounds grows with the logarithm of the longest path.
    Both sides of a join grow with the edges, so none is broadcast whatever its
    compressed size: rounds would pile up tables in the driver.
    Nodes with very many edges are met by partial aggregates and by joins that
    the adaptive planner can split. Null ends are ignored; repeated and reversed
    edges count once; an empty table gives an empty result.
    """
    now = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct()
    now = materialize(now, "edges")
    before = _mark(now)
    while before[0]:
        now = materialize(_small_star(_large_star(now)), "edges")
        after = _mark(now)
        if after == before:
            break
        before = after
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
