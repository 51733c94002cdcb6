"""Connected components of a link table by alternating large-star and small-star steps.

Links never leave the cluster: every step is a grouped minimum (summed before the shuffle, so a hub costs a
row a task) and a join that broadcasts hot hubs. Each round is written to
the shared folder. Rounds grow with the logarithm of the largest component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, given_back


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node reachable."""
    now = scratch.written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before, seen = None, _signature(now)
    while seen != before and seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
        large = given_back(both, scratch.written(least, "least"), ["u"], scratch).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.written(large, "large-star")
        low = scratch.written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")), "low")
        small = given_back(large, low, ["a"], scratch).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = scratch.written(small.distinct(), "small-star")
        before, seen = seen, _signature(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
