"""Distributed union-find: connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmarkflow.llm.steps import written


def _orient(edges: DataFrame) -> DataFrame:
    """Every edge once, from the larger node ``a`` to the smaller ``b``; no loops."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(
        "a <> b").distinct()


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node itself, move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected(edges: DataFrame, name: str, folder: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root is the smallest node.

    Each round writes the edges, which cuts the lineage. Rounds end when the
    edges are stars; loops and repeated edges do no harm, no edges give no rows.
    """
    now, before, turn = written(_orient(edges), f"{name}_0", folder), None, 0
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
                        .alias("h")).first()
        if state == before:
            break
        before, turn = state, turn + 1
        now = written(_orient(_small(_orient(_large(now)))), f"{name}_{turn}", folder)
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
