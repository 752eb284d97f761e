"""Connected components by alternating large-star and small-star steps, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1))).alias("s")).head()
    return row["n"], row["s"] or 0


def _step(current: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges u > v."""
    both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # large star: what is above a node goes to the least node around it
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    # small star: a node and what is below it go to the least of these
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    below = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def partial_components(edges: DataFrame) -> DataFrame:
    """Like ``connected_components`` after one step: nodes of one label are connected, but not the other way round."""
    stars = _step(_ordered(edges)).select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.groupBy("node").agg(F.min("component").alias("component"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: longs) to rows (node, component), the component being its smallest node.

    Nodes without an edge do not appear. Nothing is collected; each step is written, so lost executors cost one step.
    A node with very many edges is a skewed join key, which adaptive execution splits.
    """
    current = written(_ordered(edges), "llm-stars")
    state = _state(current)
    while state[0]:
        earlier, current = current, written(_step(current), "llm-stars")
        discard(earlier)
        before, state = state, _state(current)
        if before == state:
            break
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
