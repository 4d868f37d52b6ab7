"""Connected components of a link table by alternating star contractions, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.shared import cut, drop, sized


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links to (u, v) stars: v is the least node of u's component. Nodes that are the least of theirs have no row.

    Every round keeps one edge at most for each node and neighbour; the rounds needed
    grow with the logarithm of the longest chain. Self links and repeats do no harm.
    """
    edges = cut(links.select("u", "v").where("u != v").distinct(), "links")
    size = edges.count()  # no step makes more edges than it gets
    while True:
        stars = cut(sized(_small_star(sized(_large_star(sized(edges, size)), size)), size), "stars")
        drop(edges)
        rows, nodes = sized(stars.groupBy("u").agg(F.count("*").alias("_n")), size).agg(F.sum("_n"), F.count("*")).first()
        if (rows or 0) == nodes and not stars.join(stars.select(F.col("u").alias("v")), "v", "left_semi").take(1):
            return stars  # each node has one edge, and no node with an edge is the end of another
        edges = stars
