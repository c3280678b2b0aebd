"""Average linkage of a few items by their distances (CLU13)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items in one linkage: the matrix of a task has the square of this.
ITEMS = 2000


def merges(distance: np.ndarray, cuts: Sequence[int]) -> dict[int, list[int]]:
    """For each number of clusters in ``cuts``, each item's cluster, numbered from 1 by least item; of equal distances the pair of the least items merges first."""
    n = len(distance)
    groups = {i: [i] for i in range(n)}
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    found: dict[int, list[int]] = {}

    def label() -> list[int]:
        out = [0] * n
        for number, members in enumerate(sorted(groups.values(), key=min), 1):
            for m in members:
                out[m] = number
        return out

    while True:
        for k in cuts:
            if k not in found and len(groups) <= k:
                found[k] = label()
        if len(groups) <= 1 or len(found) == len(set(cuts)):
            return found
        i, j = divmod(int(np.argmin(d)), n)
        a, b = len(groups[i]), len(groups[j])
        d[i] = (a * d[i] + b * d[j]) / (a + b)
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        groups[i] += groups.pop(j)


def linked(pairs: DataFrame, a: str, b: str, distance: str, cuts: Sequence[int]) -> DataFrame:
    """item, k, cluster. pairs: each pair of items once; a missing pair or null distance counts as 1. More items than ``ITEMS`` are refused."""
    n = pairs.select(F.col(a).alias("x")).union(pairs.select(b)).distinct().count()
    if n > ITEMS:
        raise ValueError(f"{n} items to link, {ITEMS} at most")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows["a"]) | set(rows["b"]))
        at = {x: i for i, x in enumerate(names)}
        d = np.ones((len(names), len(names)))
        for x, y, v in zip(rows["a"], rows["b"], rows["d"], strict=True):
            d[at[x], at[y]] = d[at[y], at[x]] = 1.0 if pd.isna(v) else v
        return pd.DataFrame([(x, k, c) for k, label in merges(d, cuts).items() for x, c in zip(names, label, strict=True)], columns=["item", "k", "cluster"])

    rows = pairs.select(F.lit(0).alias("g"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), F.col(distance).cast("double").alias("d"))
    return rows.groupBy("g").applyInPandas(one, "item string, k int, cluster int")
