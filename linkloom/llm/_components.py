"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _finished(edges: DataFrame) -> bool:
    """Whether every edge leads to a root: no node leads to two, and no root leads on."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or (out > 0 and into > 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(u, root): each node of the edges (u, v) but the roots, with the least node of its component.

    A round costs two aggregations and two joins on the edges; rounds grow with the logarithm
    of the component size. Each round is written to the shared folder and the one before it
    dropped, so lineage stays short. Edges from a node to itself are dropped.
    """
    edges, at = scratch.save(edges.filter("u <> v"), f"{name}-0"), 0
    while True:
        at += 1
        edges = scratch.save(_small(_large(edges)), f"{name}-{at}")
        scratch.drop(f"{name}-{at - 1}")
        if _finished(edges):
            return edges.select("u", F.col("v").alias("root"))
