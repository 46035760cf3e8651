"""Connected components of an edge table by alternating stars, without gathering a group anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stowline.llm.tables import stored
from stowline.session import joinable


def components(edges: DataFrame) -> DataFrame:
    """Stored (node, component) for the nodes of stored edges (a, b): the smallest node reachable.

    Each round links every node's larger neighbours to its smallest one, then the smaller ones; both take the
    least neighbour by a map-side combined minimum and a join, so a node with many edges is split like any
    skewed join. Once all edges are stars (a node has larger neighbours only, or one smaller one and no other), the least
    neighbours are the components. Rounds are written to the shared folder. Self loops and repeats do no harm; nulls are left out.
    """
    while True:
        edges = edges.filter(F.col("a") != F.col("b"))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), (F.min("b") != F.max("b")).alias("_several"))
        ends = stored(ends, "least")
        least = ends.select("a", "m")
        if ends.filter((F.col("m") < F.col("a")) & F.col("_several")).isEmpty():
            return least.toDF("node", "component")
        large = both.join(joinable(least), "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter(F.col("a") != F.col("b"))
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = joined.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        edges = stored(small.filter(F.col("a") != F.col("b")).distinct(), "edges")
