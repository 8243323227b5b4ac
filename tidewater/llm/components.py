"""Connected components of an edge table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written


def _to_smallest(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Hang each node's neighbours (``larger_only``: those above it) on the smallest node around.

    The smallest per node comes from a partial aggregation and is written before the join, so that
    both of its sides are plain shuffles that the adaptive skew join can split at a hub."""
    smallest = written(edges.groupBy("u").agg(F.min("v").alias("m")), "component-min") \
        .withColumn("m", F.least("u", "m"))
    hung = edges.join(smallest, "u")
    if larger_only:
        return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    self_edge = smallest.select("u", F.col("m").alias("v"))
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(self_edge).where("u <> v")


def _is_star_forest(edges: DataFrame) -> bool:
    """Every ``u`` has one ``v``, and no ``v`` is a ``u``: each edge points at its component's root."""
    roles = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")) \
        .unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return roles.groupBy("n").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")) \
        .where("child + parent > 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node with an edge.

    Both steps keep the components; they end when every edge points at a root.  Depth shrinks about
    logarithmically; what is near a star already, as here, takes one round or two."""
    flat = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    current = written(flat, "component-edges")
    while not _is_star_forest(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_to_smallest(both, True).distinct(), "component-large")
        current = written(_to_smallest(large, False).distinct(), "component-small")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
