"""Connected components of a link table by alternating large-star and small-star steps.

Each step replaces links by links to smaller nodes (Kiveris and others, 2014); all of it is DataFrame
joins and aggregates over the links, written to the shared folder after each round. Nothing is collected
but one row of checksums a round. A node with very many links is pre-aggregated for its minimum, and the
join back to its links is one that Spark splits at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
    return moved.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links(a, b) but the smallest ones."""
    links = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        after = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after
        links = materialize(_small_star(_large_star(links)), "links")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
