"""Connected components by hooking, pointer jumping and contraction.

In each round every node hooks to its least smaller neighbour, chains are compressed, and
the edges are contracted onto the roots. A round leaves no node but those that are least
among their neighbours, so the edges that remain shrink by far more than half on all but
contrived inputs; rounds and jumps are logarithmic. Nothing is collected; every step is
a minimum (combined before the shuffle) or an equi-join of stored tables, whose large
partitions Spark may split. Tables between rounds are kept in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import discard, stage


def _compress(hooks: DataFrame) -> DataFrame:
    """(x, r): r becomes the root of x; parents are smaller than children, so there is no cycle."""
    held, forest = hooks, hooks
    while True:
        up = forest.select(F.col("x").alias("_x"), F.col("r").alias("_r"))
        jumped = stage(forest.join(up, F.col("r") == F.col("_x"), "left").select("x", F.coalesce("_r", "r").alias("r"), F.col("_r").isNotNull().alias("moved")), "cc-jump")
        discard(held)
        held, forest = jumped, jumped.select("x", "r")
        if jumped.where("moved").isEmpty():
            return jumped


def _relabel(df: DataFrame, name: str, roots: DataFrame) -> DataFrame:
    to = roots.select(F.col("x").alias("_x"), F.col("r").alias("_r"))
    return df.join(to, F.col(name) == F.col("_x"), "left").withColumn(name, F.coalesce("_r", name)).drop("_x", "_r")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: two columns of long ids, in any order, repeats and loops allowed.

    Returns (node, root) of every node that is not the least of its component; root
    is that least node.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = stage(edges.where("a <> b").distinct(), "cc-edges")
    labels = edges.sparkSession.createDataFrame([], "node long, root long")
    while not edges.isEmpty():
        held = _compress(stage(edges.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("r")), "cc-hooks"))
        roots, before = held.select("x", "r"), (labels, edges)
        labels = _relabel(labels, "root", roots).unionByName(roots.select(F.col("x").alias("node"), F.col("r").alias("root")))
        labels = stage(labels, "cc-labels")
        moved = _relabel(_relabel(edges, "a", roots), "b", roots).where("a <> b")
        edges = stage(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
        for old in (*before, held):
            discard(old)
    discard(edges)
    return labels
