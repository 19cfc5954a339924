"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logframe.llm.common import durable


#: A node is a hub from so many edges on, or from the 100,000th part of all edges if that is more: so hubs are few.
HUB, FEW = 20_000, 100_000


def _with_least(edges: DataFrame, least: DataFrame, n: int, hub: int) -> DataFrame:
    """``edges`` with each node's ``m`` of ``least`` (a, m, n): of hubs by a broadcast, so that no task gets a hub's edges."""
    hubs = least.filter(F.col("n") >= max(hub, n // FEW)).select("a", F.col("m").alias("hub"))
    if n < hub or hubs.isEmpty():
        return edges.join(least, "a").drop("n")
    marked = edges.join(F.broadcast(hubs), "a", "left")
    rest = marked.filter("hub IS NULL").drop("hub").join(least, "a").drop("n")
    return rest.unionByName(marked.filter("hub IS NOT NULL").withColumnRenamed("hub", "m"))


def _large_star(edges: DataFrame, n: int, hub: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _with_least(both, least, n, hub).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int, hub: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, n, hub).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node of its component.

    Every round only groups, joins and deduplicates the edge table; no component is
    gathered anywhere, and a node with very many edges shares no task with them: its
    smallest neighbour is told to them by a broadcast. The rounds end when one leaves the table as it was. Edges from a
    node to itself are dropped; an empty edge table gives an empty result.
    """
    edges = durable(edges.filter("a <> b").select("a", "b").distinct())
    edges = durable(_small_star(edges, edges.count(), hub))
    before = _state(edges)
    while before[0]:
        larger = _large_star(edges, before[0], hub)
        larger = durable(larger) if before[0] >= hub else larger
        edges = durable(_small_star(larger, before[0], hub))
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
