"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the smallest node that each end of ``edges`` (a, b) reaches.

    Each step is an aggregation with map-side combine and a join on the node, so
    a hub is split like any skewed join key, and every round writes its edges to
    the shared folder. The rounds grow with the logarithm of the longest path.
    """
    work = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}0")
    before, step = None, 0
    while True:
        # large star: every larger neighbour of u is tied to the smallest one of u
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: u and its smaller neighbours are tied to the smallest of them
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        step += 1
        now = scratch.save(small, f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work = now
        if mark == before:
            break
        before = mark
    return work.select(F.col("u").alias("node"), F.col("v").alias("component"))
