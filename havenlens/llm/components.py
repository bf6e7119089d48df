"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from havenlens.llm.common import done_with, join_keys, stored


def connected_components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node it can reach.

    `links` has two bigint columns a and b. Each round points every node's larger neighbours, then its smaller ones, at
    the smallest neighbour; a few rounds do for any shape. A round is two grouped minima with map-side combining and two
    joins, in which a node with very many links is broadcast under a proven bound rather than met in one task. It is stored,
    so neither the links nor the lineage pass through the driver: it sees one checksum a round.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _checksum(edges)
    while state[0]:
        larger = stored(_large_star(edges), name)  # read several times by the next step
        former, edges = edges, stored(_small_star(larger), name)
        done_with(former, larger)
        before, state = state, _checksum(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger node a to the smaller b. Every larger neighbour of a node is linked to its least one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count("*").alias("n"))
    return join_keys(both.where("b > a"), least, "a", "n").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))
    moved = join_keys(edges, least, "a", "n").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
