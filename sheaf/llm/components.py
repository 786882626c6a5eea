"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import rows
from sheaf.llm.store import remove, written


def components(links: DataFrame, at: str) -> DataFrame:
    """(node, root): the smallest node that each node of the links (a, b) reaches; nodes that are their own are left out.

    The links stay a table. Each round points every node's neighbours at the smallest of them, first the larger
    neighbours, then the smaller ones, and is written, so the lineage stays short; rounds grow with the
    logarithm of the longest path. Smallest neighbours are found with map-side aggregation. They are sent to
    the links where those are few; beyond that a node of many links is joined apart, so its links never meet.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    edges = written(edges.distinct(), f"{at}/0")
    turn, last, count = 0, None, edges.count()

    def pointed(table: DataFrame, least: DataFrame, step: str) -> DataFrame:
        if count <= rows.BROADCAST_KEYS:  # no more nodes than twice the links
            return table.join(F.broadcast(least.drop("degree")), "v")
        return rows.matched(table, written(least, f"{at}/{turn}-{step}"), ["v"], "degree")

    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"), F.count("*").alias("degree"))
        star = pointed(both.where("u > v"), least, "large").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        if count > rows.BROADCAST_KEYS:
            star = written(star, f"{at}/{turn}-star")
        least = star.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("degree"))
        drawn = pointed(star, least, "small")
        star = drawn.where("u <> m").select(
            F.col("u").alias("v"), F.col("m").alias("u")
        ).unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        turn += 1
        edges = written(star, f"{at}/{turn}")
        for old in (f"{turn - 1}", *(f"{turn - 1}-{step}" for step in ("large", "star", "small"))):
            remove(spark, f"{at}/{old}")
        # unchanged edges mean stars; their number and two sums of hashes tell, with no comparison of tables
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1)))).first()
        if now == last:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        last, count = now, now[0]
