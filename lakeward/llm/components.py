"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm.shared import discard, stored


def _least_neighbour(links: DataFrame) -> DataFrame:
    least = links.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    return links.join(least, F.col("u") == F.col("k")).drop("k")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = F.least("m", "u")
    return _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), least.alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    moved = least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def roots(links: DataFrame) -> DataFrame:
    """``u``, ``v`` for every node of ``links`` but the roots: ``v`` is the least node
    reachable from ``u``. Each round is written to the shared folder."""
    spark = links.sparkSession
    now = stored(links.where("u <> v").select("u", "v"), "links")
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        if not mark[0]:
            break
        large = stored(_large_star(now), "large-star")
        discard(spark, now)
        now = stored(_small_star(large), "small-star")
        discard(spark, large)
    return now
