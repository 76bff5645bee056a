"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _rejoin(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with the ``m`` of their u. ``least`` has a row for each u, dealt by u already; under a
    key that Spark can't know to be dealt, the join shuffles both sides, so that adaptive execution may
    split the edges of a node that very many nodes are linked to."""
    return edges.join(least.select((F.col("u") + F.lit(0)).alias("u"), "m"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _rejoin(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _rejoin(down, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """(u, v) of longs -> (node, root): the least node that each linked node reaches.

    Rounds go on until one changes nothing; they grow with the logarithm of the longest path, and
    every one is written to the shared folder. Only nodes that have a link to another node come back.
    """
    edges, was, turn = materialize(links.filter("u <> v").select("u", "v").distinct(), "links"), None, 0
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if not now[0] or tuple(now) == was:
            break
        was, turn = tuple(now), turn + 1
        edges = materialize(_small_star(_large_star(edges)).filter("u <> v").distinct(), f"stars-{turn}")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
