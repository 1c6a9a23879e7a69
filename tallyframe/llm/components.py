"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.store import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); the root is the smallest node.

    A round joins each node's smallest neighbour to its neighbours, first upwards, then downwards,
    until the edges are stars. Rounds grow with the logarithm of the longest chain, and each is
    written to the shared folder. Edges of a node to itself and repeated edges do no harm.
    """
    e = stage(_down(edges), "edges")
    print_of = _print(e)
    while print_of[0]:
        e = stage(_small(_large(e)), "edges")
        last, print_of = print_of, _print(e)
        if last == print_of:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _down(edges: DataFrame) -> DataFrame:
    return (edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())


def _print(e: DataFrame):
    """Number of edges and a sum over them that tells two sets of edges apart."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(e.agg(F.count(F.lit(1)), F.sum(h)).first())


def _large(e: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest of its neighbourhood."""
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
        # nodes without a larger neighbour keep their edge to the smallest
        low.where("m < n").select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def _small(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
    moved = e.join(low, F.col("u") == F.col("n")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
