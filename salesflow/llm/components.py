"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.llm._common import materialize_few


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, rows: int, path: str) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    near = _both_ways(edges)
    # The smallest neighbours are written, so that their join has a shuffle on either side and Spark can
    # split a node that most edges meet in.
    least = materialize_few(near.groupBy("u").agg(F.min("v").alias("m"))
                            .select("u", F.least("u", "m").alias("m")), 2 * rows, path)
    return (near.filter(F.col("v") > F.col("u")).join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())


def _small_star(edges: DataFrame, rows: int, path: str) -> DataFrame:
    """Every node's smaller neighbours, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize_few(down.groupBy("u").agg(F.min("v").alias("m")), rows, path)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, folder: str) -> DataFrame:
    """u, root: for every node of ``edges`` (u, v; longs) other than a root, its component's smallest node.

    Each round is written to ``folder``, so the lineage stays short and a lost
    executor costs one round at most; the driver sees a count and a checksum.
    """
    now = materialize_few(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct(), edges.count(), f"{folder}/round-0")
    state, step = _state(now), 0
    while state[0]:
        step += 1
        rows = state[0]
        wide = _large_star(now, rows, f"{folder}/large-{step}")
        now = materialize_few(_small_star(wide, rows, f"{folder}/small-{step}"), 2 * rows, f"{folder}/round-{step}")
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select("u", F.col("v").alias("root"))
