"""A graph of artifacts by the digests that they name of each other, verified level by level.

Nodes are artifacts with the digest they have now; an edge says which digest a
parent has recorded of a child. A node is sound if every child that it names is
there, has the digest that it recorded, and is sound. The graph is peeled from
its leaves: each round settles the nodes whose children are all settled, so work
goes by depth and every round is a join; what is never settled lies on a
cycle or above one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.storage import materialize


def scanned(rows: DataFrame) -> DataFrame:
    """node, digest of scanned files (sources.files.scan)."""
    return rows.select(F.col("path").alias("node"), F.sha2("content", 256).alias("digest"))


def freeze(nodes: DataFrame, name: str) -> DataFrame:
    """parent (name), child, expected: a freeze of the nodes, an edge for each; its own digest is that of all edges in order."""
    return nodes.select(F.lit(name).alias("parent"), F.col("node").alias("child"), F.col("digest").alias("expected"))


def frozen_node(frozen: DataFrame) -> DataFrame:
    """node, digest of freezes: the digests of their edges added up, so that no task holds them all and order plays no part."""
    edge = F.sha2(F.concat_ws("\0", "parent", "child", "expected"), 256)
    part = lambda k: F.sum(F.conv(F.substring(edge, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)"))
    sums = frozen.groupBy(F.col("parent").alias("node")).agg(F.concat_ws(":", F.count("*").cast("string"), *[part(k).cast("string") for k in range(8)]).alias("_sum"))
    return sums.select("node", F.sha2("_sum", 256).alias("digest"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, level (0 without children, else one more than the highest child; null on or above a cycle)."""
    names = nodes.select("node").unionByName(edges.select(F.col("parent").alias("node"))).unionByName(edges.select(F.col("child").alias("node"))).distinct()
    left = materialize(edges.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL").distinct(), "open")
    waiting = left.select(F.col("parent").alias("node")).distinct()
    ready = materialize(names.join(waiting, "node", "left_anti").withColumn("level", F.lit(0)), "settled")
    settled, level = ready, 0
    while not left.isEmpty() and not ready.isEmpty():
        level += 1
        parents = left.select("parent").distinct()
        left = materialize(left.join(ready.select(F.col("node").alias("child")), "child", "left_anti").select("parent", "child"), "open")
        freed = parents.join(left.select("parent").distinct(), "parent", "left_anti")
        ready = materialize(freed.select(F.col("parent").alias("node"), F.lit(level).alias("level")), "settled")
        settled = settled.unionByName(ready)
    return names.join(settled, "node", "left")


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, problem, parent, level: where the graph first breaks.

    missing: a child that is not there, for each parent; digest: one whose digest is
    another than the parent recorded; repeated: a node with several digests; cycle:
    a node on or above a cycle. A break is told where it is; what merely stands
    above it is in `affected`. A sound graph gives no row.
    """
    placed = levels(nodes, edges)
    known = nodes.groupBy("node").agg(F.count_distinct("digest").alias("n"), F.max("digest").alias("digest"))
    met = edges.distinct().join(known.withColumnRenamed("node", "child"), "child", "left")
    wrong = F.when(F.col("n").isNull(), "missing").when((F.col("n") == 1) & ~F.col("digest").eqNullSafe(F.col("expected")), "digest")
    broken = met.select(F.col("child").alias("node"), wrong.alias("problem"), "parent").where("problem IS NOT NULL")
    several = known.where("n > 1").select("node", F.lit("repeated").alias("problem"), F.lit(None).cast("string").alias("parent"))
    cycles = placed.where("level IS NULL").select("node", F.lit("cycle").alias("problem"), F.lit(None).cast("string").alias("parent"))
    return broken.unionByName(several).unionByName(cycles).join(placed, "node", "left")


def affected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, cause, cause_level: for every node above a break the lowest broken node below it, ties to the first name.

    Causes rise one level a round, from the least level on, so the first that reaches a node is the deepest.
    """
    found = materialize(problems(nodes, edges), "problems")
    causes = found.groupBy("node").agg(F.min(F.coalesce("level", F.lit(1 << 30))).alias("cause_level"))
    pairs = edges.select("parent", "child").distinct()
    best = materialize(causes.select("node", F.col("node").alias("cause"), "cause_level"), "causes")
    while True:
        raised = pairs.join(best.withColumnRenamed("node", "child"), "child").select(F.col("parent").alias("node"), "cause", "cause_level")
        least = F.min(F.struct("cause_level", "cause")).alias("m")
        after = best.unionByName(raised).groupBy("node").agg(least).select("node", "m.cause", "m.cause_level")
        after = materialize(after, "causes")
        if after.exceptAll(best).isEmpty():
            return after
        best = after
