"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import cut


def _least(pairs: DataFrame) -> DataFrame:
    """Pairs (c, x) with ``m``, the least of c and all its x.

    The pairs of one c are dealt by x over as many slots as there are shuffle partitions, both for the minimum and for
    the join that brings it back, so a node with very many links is spread whatever their number.
    """
    slots = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.withColumn("slot", F.pmod(F.xxhash64("x"), F.lit(slots)).cast("int"))
    by_slot = pairs.groupBy("c", "slot").agg(F.min("x").alias("m"))
    least = by_slot.groupBy("c").agg(F.least("c", F.min("m")).alias("m"))
    return pairs.join(by_slot.select("c", "slot").join(least, "c"), ["c", "slot"]).drop("slot")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour of u that is larger (large star) or smaller (small star) to u's least one."""
    if large:
        both = edges.select(F.col("u").alias("c"), F.col("v").alias("x")).unionByName(edges.select(F.col("v").alias("c"), F.col("u").alias("x")))
        linked = _least(both).filter("x > c").select(F.col("m").alias("u"), F.col("x").alias("v"))
    else:
        linked = _least(edges.select(F.greatest("u", "v").alias("c"), F.least("u", "v").alias("x")))
        linked = linked.select(F.col("m").alias("u"), F.explode(F.array("x", "c")).alias("v"))
    return linked.filter("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component: the least node reached.

    Ends when every edge leads to the centre of a star.
    """
    edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct())
    while not _are_stars(edges):
        edges = cut(_star(_star(edges, True), False))
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Has every node one edge to a smaller node at most, and none if it has edges to larger ones?"""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("u").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()
