"""Connected components by alternating large-star and small-star, on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex sends its larger neighbours to the least of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex sends its smaller neighbours and itself to the least of them; edges point from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str = "star") -> DataFrame:
    """(node, component) of every node in an edge; the component is its least node. edges: (u, v), any direction.

    Each round is written to the shared folder; the edges end as stars around the least node of each component.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch.save(pairs, f"{name}0")
    mark, k = _mark(now), 0
    while mark[0]:
        step = scratch.save(_small_star(_large_star(now)), f"{name}{k + 1}")
        after = _mark(step)
        scratch.drop(f"{name}{k}")
        now, k = step, k + 1
        if after == mark:
            break
        mark = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
