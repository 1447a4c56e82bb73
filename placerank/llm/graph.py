"""Connected components of an edge table by contraction: joins and aggregates only, nothing reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.session import settle


def _roots(to: DataFrame) -> DataFrame:
    """(x, p) with every pointer p followed to its end, which points at itself; the way left halves each turn."""
    while True:
        hop = to.select(F.col("x").alias("p"), F.col("p").alias("q"))
        to = settle(to.join(hop, "p").select("x", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
        if to.where("moved").isEmpty():
            return to.select("x", "p")
        to = to.select("x", "p")


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for every node of the edges (a, b); self-loops count as nodes.

    Each round every node points at its smallest neighbour, if that is smaller, pointers are followed to their ends, and the
    edges are drawn anew between the ends; edges inside a component vanish.  An end that nobody pointed at has neighbours
    that went to smaller ends, so it goes too in the next round: two rounds halve the nodes in any order of ids.  A path in
    order of ids and a star, however large, take one."""
    edges = settle(edges.select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = settle(nodes.withColumn("label", F.col("node")))
    live = edges.where("a <> b")
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = _roots(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p")))
        labels = settle(labels.join(to.withColumnRenamed("x", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label")))
        ends = live.join(to.select(F.col("x").alias("a"), F.col("p").alias("pa")), "a")
        ends = ends.join(to.select(F.col("x").alias("b"), F.col("p").alias("pb")), "b")
        live = settle(ends.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    return labels
