"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop, join_unique, scratch


def _with_least(links: DataFrame) -> DataFrame:
    """links (a, b) with m, the smallest b of a; the centre of a large star is no hot key of a shuffle."""
    least = cut(links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")))
    return join_unique(links, least, ["a"], "degree", least.agg(F.sum("degree")).first()[0] or 0, "inner").drop("degree")


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its smallest neighbour (itself included)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, go to the smallest of them."""
    down = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    met = _with_least(down)
    moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return met.select("a", F.col("m").alias("b")).unionByName(moved).distinct()


def connected(links: DataFrame) -> DataFrame:
    """node, label for each node of links (a, b): label is the smallest node it reaches.

    The link table alone is rewritten, in the cluster; a round's total tells the driver whether it is stable.
    """
    spark = links.sparkSession
    now = cut(links.filter("a <> b").select("a", "b"))
    before = None
    while True:
        with scratch(spark) as s:
            after = s.keep(cut(_small_star(_large_star(now))))
        drop(spark, now._written_at)
        now = after
        total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total == before:
            break
        before = total
    own = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return own.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
