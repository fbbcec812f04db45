"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import written


Keep = Callable[[DataFrame, str], DataFrame]


def stars(edges: DataFrame, small: bool, keep: Keep) -> DataFrame:
    """Each node's neighbours linked to the smallest of the node and its neighbours: the larger ones (large star), or the smaller and the node itself (small star)."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = keep(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lows")
    met = near.join(low, "a")
    out = met.filter(F.col("b") != F.col("m")).select("b", "m") if small else met.filter(F.col("b") > F.col("a")).select("b", "m")
    if small:
        out = out.unionByName(low.filter(F.col("a") != F.col("m")).select(F.col("a").alias("b"), "m"))
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, keep: Keep = written) -> DataFrame:
    """(node, component) of every node of an (a, b) edge list; the component is its smallest node.

    Rounds go on until one changes nothing; each round's edges are written, so
    neither lineage nor a lost executor's work grows with the rounds. What a join
    takes from an aggregate is written too: both its sides are then plain
    shuffles, which Spark can split where one node has many edges.
    """
    now = keep(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges")
    before = None
    while True:
        now = keep(stars(stars(now, False, keep), True, keep), "edges")
        state = now.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
