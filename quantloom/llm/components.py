"""Connected components of a link table, by alternating large-star and small-star steps on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import released, saved


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first())


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to its smallest one: the larger neighbours if ``large``, else the smaller ones and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        found = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        found = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return found.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)``; ``root`` is the smallest node that can be reached.

    Links are undirected and may repeat; a link of a node with itself, or with null, says nothing. Links never grow in
    number, none reach the driver, and every round is a table of its own. Without links the result is empty.
    """
    links = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(links)
    while before[0]:
        old, links = links, saved(_star(_star(links, large=True), large=False))
        released(old)
        after = _state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.withColumn("root", F.col("node")))
