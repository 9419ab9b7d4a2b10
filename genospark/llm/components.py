"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


#: Edges of a node that make it a hub; with more than 2^18 times as many edges in all, the number is larger.
HUB = 256


def _told(edges: DataFrame, least: DataFrame, node: str) -> DataFrame:
    """``edges`` with the least neighbour ``m`` of ``node``.  Hubs are few, so they meet their edges by broadcast."""
    least = stored(least, "cc-least")
    facts = least.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    hub_from = max(HUB, facts["n"] >> 18)
    if facts["most"] <= hub_from:
        return edges.join(least.drop("n"), node)
    hubs = F.broadcast(least.where(F.col("n") > hub_from).drop("n"))
    others = edges.join(hubs.select(node), node, "left_anti").join(least.where(F.col("n") <= hub_from).drop("n"), node)
    return edges.join(hubs, node).unionByName(others)


def _stars(edges: DataFrame) -> bool:
    """Whether every node has at most one smaller neighbour, and that one has none; further steps would change nothing."""
    if not edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, component_id) for the nodes of ``links`` (x, y); component_id is the smallest ``id`` of the component.

    ``ids`` has (node, id).  Each step joins the edges with the smallest neighbour of their nodes; a node of very
    many edges meets it by broadcast.  The steps end, after about log of the largest component, as soon as all
    components are stars; links that are stars from the start take none.
    """
    edges = stored(links.select(F.least("x", "y").alias("v"), F.greatest("x", "y").alias("u")).where("u != v").distinct(), "cc-edges")
    while not _stars(edges):
        # Large star: every larger neighbour of a node moves to the node's smallest neighbour.
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))  # v -> neighbour u
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = stored(_told(both.where("u > v"), least, "v").select(F.col("m").alias("v"), "u").where("u != v").distinct(), "cc-large")
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = _told(large, least, "u")
        small = moved.where("v != m").select(F.col("m").alias("v"), F.col("v").alias("u")).union(moved.select(F.col("m").alias("v"), "u"))
        new = stored(small.where("u != v").distinct(), "cc-edges")
        discard(edges, large)
        edges = new
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
    named = stored(named.join(ids, "node").select("node", "root", "id"), "cc-named")
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return named.join(smallest, "root").select("node", "component_id")
