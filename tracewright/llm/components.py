"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def star_step(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node (the larger ones, or the smaller ones and itself) to the least of them."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    least = around.groupBy("a").agg(F.min("b").alias("low"))
    joined = around.join(least, "a")
    if large:
        own = F.least("a", "low")
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), own.alias("b"))
    else:
        moved = joined.where(F.col("b") > F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether every node is a leaf with one edge or a centre, never both: then the centres are the roots."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre"))
    )
    seen = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return not seen.where("leaf > 1 or leaf = 1 and centre = 1").limit(1).collect()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the least node of its component.

    Ends must be comparable; edges with a null end are left out, as are loops. No edges, no rows. A step
    costs two shuffles of the edges; the lineage is cut in the shared folder after each pair of steps, and
    steps go on until all that is left are stars, which the method reaches in O(log^2 n) rounds. Nothing
    but a row that says so comes to the driver. A hub's neighbours are rows, never a list; the join that
    meets them with its least neighbour is split by adaptive execution where the hub is skewed.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    current = durable(edges.where(F.col(a) != F.col(b)).select(high.alias("a"), low.alias("b")).distinct(), "edges")
    while not are_stars(current):
        after = durable(star_step(star_step(current, True), False), "edges")
        discard(current)
        current = after
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
