"""Connected components of a link table, as alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import drop_table, materialize, split_join


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest one."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return split_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of u, and u itself, are linked to the smallest one. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = split_join(edges, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


#: Edges per file of the written edge tables.
FILE_EDGES = 500_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _written(edges: DataFrame, about: int) -> DataFrame:
    """The edges in files of about FILE_EDGES, not one for each shuffle partition."""
    return materialize(edges.coalesce(about // FILE_EDGES + 1), "edges")


def components(links: DataFrame, about: int, max_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for every node of links(u, v); integer nodes.

    `about` is a guess of the number of links, for the number of files they are written to.

    The edge table is written to the shared folder after each round; only its count and a
    checksum reach the driver. A node with very many neighbours is split by adaptive execution. Ends when a round changes nothing: all edges then are stars.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = _written(edges, about)
    before = _state(edges)
    if before[0] == 0:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        after = _written(_small_star(_large_star(edges)), before[0])
        drop_table(edges)
        edges, state = after, _state(after)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
