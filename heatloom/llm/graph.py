"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.session import materialise


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for all nodes of links (a, b); both are longs, in any order.

    Alternates two steps until nothing changes: each node hands its smallest
    neighbour to its larger ones, then to its smaller ones. Either is an
    aggregate with a map-side part and a join that may be split, so a node with
    a third of all links is no task of its own (the aggregate is written first:
    joined in its own stage, it would keep that node's links together); rounds grow with the logarithm
    of the components' extent. Every round is written to the scratch folder.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges, mark = materialise(edges, "links"), None
    while (now := _mark(edges)) != mark:
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).withColumn("m", F.least("n", "m"))
        least = materialise(least, "least")
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "links")
        least = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = small.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
        edges = materialise(small, "links")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.withColumn("label", F.col("node")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first())
