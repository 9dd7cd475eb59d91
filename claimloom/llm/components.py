"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b) but the roots; a root is its component's smallest node.

    Alternates two steps until no link changes: every node's larger neighbours are linked to its smallest one, then
    every node's neighbours that are not larger are.  Links never grow in number, and rounds grow with the logarithm
    of the longest path.  A node with very many neighbours is aggregated map-side first, and joins with it are plain
    equality joins whose partitions can be split.  Each round is written to the shared folder.
    """
    links = cut_lineage(links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a != b").distinct())
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = None
    while True:
        # Large star: neighbours on both sides; the larger ones move to the smallest.
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        larger = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut_lineage(larger.filter("a != b").distinct())
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a")
        links = cut_lineage(moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
