"""Connected components by alternating stars, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaytally.llm.common import dealt_join, written


def _linked(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """Each edge's far end with the smallest neighbour of its near end; a node with very many edges is dealt out."""
    return dealt_join(edges, low, ["u"], F.xxhash64("v"), total).select(F.col("v").alias("u"), F.col("low").alias("v"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge to a node that no edge leaves."""
    several = edges.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low <> high")
    between = edges.join(edges.select(F.col("v").alias("end")), F.col("u") == F.col("end"), "left_semi")
    return several.isEmpty() and between.isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of the edges (u, v).

    A round links larger neighbours, then smaller ones, to the smallest neighbour; the number of
    rounds grows with the logarithm of the longest path. Each round is written to the shared folder."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _are_stars(now):
            break
        total = 2 * now.count()
        edges = F.count(F.lit(1)).alias("__many")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"), edges).select("u", F.least("u", "low").alias("low"), "__many")
        large = _linked(both.where("v > u"), low, total).unionByName(low.where("low < u").select("u", F.col("low").alias("v"))).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("low"), edges)
        small = _linked(large, least, total).where("u <> v").unionByName(least.select("u", F.col("low").alias("v")))
        now = written(small.distinct(), "edges")
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
