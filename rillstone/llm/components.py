"""Connected components of a graph given as links, by alternating large and small stars.

Every round replaces links by links to smaller neighbours without changing what is reachable; it ends
with stars around the smallest node. Links, labels and components stay in tables of the shared folder, and a
round's tables go when the next is written; the driver sees a few numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.store import Scratch, join_split, materialize


def _large(links: DataFrame, n: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows")).withColumn("m", F.least("a", "m"))
    return join_split(both.filter("b > a"), least, "a", total=2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame, n: int) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows"))
    moved = join_split(down, least, "a", total=n).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, into: Scratch | None = None, rounds: int = 50) -> DataFrame:
    """node, component (its smallest node) of every node in links (a, b), written; nodes are longs, never null."""
    tables = Scratch(links.sparkSession)
    now, seen = tables.write(links.filter("a <> b").select("a", "b").distinct(), "links"), None
    for _ in range(rounds):
        step = Scratch(links.sparkSession)
        large = step.write(_large(now, now.count()), "large")
        now = step.write(_small(large, large.count()), "small")
        tables.clear()
        tables = step
        said = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if said == seen:
            break
        seen = said
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
    found = into.write(stars, "components") if into else materialize(stars, "components")
    tables.clear()
    return found
