"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from permspark.sources.writers import staged


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half step; edges (u, v) with u > v.

    Large star: the greater neighbours of every node are linked to its smallest neighbour (itself included). Small star: the
    lesser neighbours and the node itself are linked to the smallest of them.
    """
    sides = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # stored, so that adaptive execution can split the edges of a hub
    least = staged(sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")))
    met = sides.join(least, F.col("u") == F.col("n"))
    if large:
        moved = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link, from links (a, b); root is the smallest node that is reachable.

    Every round is a few joins and sums, stored before the next one; the rounds grow with the logarithm of the longest path.
    """
    edges = staged(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _print(edges)
    while mark[0]:
        edges = staged(_stars(_stars(edges, True), False))
        before, mark = mark, _print(edges)
        if mark == before:
            break
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
