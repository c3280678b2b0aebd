"""Connected components by alternating large-star and small-star steps, each an aggregation and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import kept


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for each node of ``edges`` (a, b). Loops, repeats and nulls are ignored.

    Each step keeps the components and shortens the paths; the edges end as a star around each
    least node. No node's neighbours are gathered: a step takes their least, then joins it back.
    """
    now = kept(_ordered(edges))
    while True:
        big = _star(now, True)
        after = kept(_star(big, False))
        # a star forest: no node is both a child and a parent, and no child has two parents
        odd = after.groupBy("v").agg(F.count("*").alias("k")).where("k > 1").select("v").union(after.select(F.col("u").alias("v")).join(after.select("v"), "v", "left_semi"))
        now = after
        if odd.isEmpty():
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges u < v."""
    return edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node ties its larger neighbours to its least one (or itself); small: each ties its smaller ones, and itself, to its least."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        both = both.union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    else:
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    tied = both.join(least, "x")
    if large:
        out = tied.where("y > x").select(F.col("m").alias("a"), F.col("y").alias("b"))
    else:
        out = tied.select(F.col("m").alias("a"), F.col("y").alias("b")).union(least.select(F.col("m").alias("a"), F.col("x").alias("b")))
    return _ordered(out)
