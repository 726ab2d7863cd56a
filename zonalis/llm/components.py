"""Distributed connected components by alternating large-star and small-star steps.

Every step is a min per node and a join back; no neighbour list, component or edge list is gathered in one place. Each
round is checkpointed to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_files, shared_dir


def _hung(edges: DataFrame) -> DataFrame:
    """Edges with the least neighbour m of u, or u itself where that is less: (u, v, m)."""
    least = edges.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, component) for the nodes of edges (u, v): the smallest node reachable. Loops, repeats and nulls do no harm.

    files: of a checkpoint, see `in_files`; without it, one for each partition of a shuffle.
    """
    shared_dir(edges.sparkSession)
    cur = in_files(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), files).checkpoint()
    state = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hung(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        hung = _hung(large)
        small = hung.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        cur = in_files(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), files).checkpoint()
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    least = cur.groupBy("u").agg(F.min("v").alias("component"))
    roots = least.select(F.col("component").alias("u")).distinct().withColumn("component", F.col("u"))
    return least.unionByName(roots).groupBy("u").agg(F.min("component").alias("component")).withColumnRenamed("u", "node")
