"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one: those above each node (large) or below it (small).

    Minima are aggregated before the join, so a node with very many neighbours is a skewed join,
    which adaptive execution splits, and never a collected list.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = common.skew_join(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hung.filter("u <> v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = common.skew_join(edges, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return hung.union(own).filter("u <> v").distinct()


def components(links: DataFrame, src: str, dst: str) -> DataFrame:
    """node, component_id (the smallest node reachable) for every node that has a link."""
    edges = common.staged(
        links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct(), "edges"
    )
    mark = None
    while True:
        stars = common.staged(_star(_star(edges, True), False), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, edges = now, stars
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    )
