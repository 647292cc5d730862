"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.session import forget, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Each round hooks every neighbour of a node to the smallest of them, larger ones first, then smaller
    ones; the edges become stars in about the logarithm of the longest path. Minima are aggregated
    before the shuffle and joined back, so no neighbourhood is gathered; the rounds are written to the
    shared folder, each in place of the one before.
    """
    state = materialize(_downward(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    mark = _mark(state)
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, state = state, materialize(_downward(small.union(lowest.select("u", F.col("m").alias("v")))))
        forget(old)
        before, mark = mark, _mark(state)
        if mark == before:
            break
    roots = state.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _downward(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Tells two edge sets apart without comparing them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
