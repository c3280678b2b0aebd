"""Ranks with ties, Borda points and best-of selections over long score tables (WIN, TOP, AGG05-10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_ties(within: Sequence[str], by: Column, ties: Sequence[str | Column], method: str = "average") -> Column:
    """Rank in order ``by``; equal ``ties`` share a rank: the least ("min") or the mean of their places ("average")."""
    least = F.rank().over(Window.partitionBy(*within).orderBy(by))
    if method == "min":
        return least
    return least + (F.count(F.lit(1)).over(Window.partitionBy(*within, *ties)) - 1) / 2


def borda(scores: DataFrame, method: str = "average", offset: int = 0) -> DataFrame:
    """model, points, rank: in each task n_models - r + ``offset`` points, with n_models of the whole table. A missing score brings none."""
    n = scores.select("model").distinct().agg(F.count("*").alias("n_models"))
    ranked = scores.where(F.col("score").isNotNull()).withColumn("r", rank_ties(["task"], F.desc("score"), ["score"], method))
    points = ranked.crossJoin(F.broadcast(n)).groupBy("model").agg(F.sum(F.col("n_models") - F.col("r") + offset).alias("points"))
    every = scores.select("model").distinct().join(points, "model", "left").select("model", F.coalesce("points", F.lit(0.0)).cast("double").alias("points"))
    return every.withColumn("rank", F.rank().over(Window.orderBy(F.desc("points"))).cast("long"))


def best_rows(rows: DataFrame, within: Sequence[str], *order: Column, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group in an order that must break all ties."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def last_known(rows: DataFrame, keys: Sequence[str], by: str, columns: Sequence[str]) -> DataFrame:
    """One row for each key; each column its value at the largest ``by`` among rows where it isn't null."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(by)))
    return rows.groupBy(*keys).agg(F.max(by).alias(by), *[known(c).alias(c) for c in columns if c != by])
