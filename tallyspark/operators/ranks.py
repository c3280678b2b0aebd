"""Kendall's tau from inversions and exact null distributions (STA02, STA04, STA05): no pair of rows is built.

Of one large sample, pairs in opposite order are counted in three parts. Boundaries cut both columns into blocks of like size.
Pairs in one block of x are counted by merging in its task; pairs in different blocks of both columns come from the table of
block counts; pairs in different blocks of x and one block of y are counted by merging in that block's task. A value
that is a boundary is a block of its own, so one that a third of the rows have needs no merging at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import two_sided

#: Distinct pairs of values in a block, about, and the most boundaries.
BLOCK, EDGES = 100_000, 512
#: Rows up to which tau's distribution is exact, and of the smaller sample for U's; both only without ties.
EXACT_TAU, EXACT_U = 33, 8


def opposite(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> float:
    """The weight of pairs with x_i < x_j and y_i > y_j, by merging sorted runs that double in length."""
    n = len(x)
    w = np.ones(n) if w is None else w.astype(float)
    order = np.lexsort((y, x))
    y, w = np.unique(y, return_inverse=True)[1].astype(np.int64)[order], w[order]
    place, top, total, size = np.arange(n), int(y.max(initial=0)) + 1, 0.0, 1
    while size < n:
        run = place // size
        keys = run * top + y  # ascending: each run is sorted by y
        upto = np.concatenate([[0.0], np.cumsum(w)])
        right = np.flatnonzero(run % 2 == 1)
        left = run[right] - 1
        # what stands before a right row in the run to its left, and has a larger y
        first = np.searchsorted(keys, left * top + y[right], "right")
        total += float((w[right] * (upto[(left + 1) * size] - upto[first])).sum())
        merged = np.argsort((place // (2 * size)) * top + y, kind="stable")
        y, w, size = y[merged], w[merged], 2 * size
    return total


def _ties(rows: DataFrame, *by: str) -> DataFrame:
    t = F.col("t")
    n = rows.groupBy(*by).agg(F.sum("w").alias("t"))
    return n.agg(F.coalesce(F.sum(t * (t - 1) / 2), F.lit(0.0)).alias("two"), F.coalesce(F.sum(t * (t - 1) * (t - 2)), F.lit(0.0)).alias("three"), F.coalesce(F.sum(t * (t - 1) * (2 * t + 5)), F.lit(0.0)).alias("five"))


def kendall_large(rows: DataFrame, x: str, y: str, block: int = BLOCK) -> DataFrame:
    """n, opposite, tau (tau-b), z and p of one sample of any size: a row. Rows with a null or NaN in either column are left out; without variance tau is null. p is exact where ``EXACT_TAU`` allows."""
    spark = rows.sparkSession
    known = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    cells = known.groupBy("x", "y").agg(F.count("*").cast("double").alias("w")).persist()
    try:
        size = cells.count()
        edges = min(EDGES, -(-size // block) - 1) if size else 0
        cuts = [sorted(set(c)) for c in cells.approxQuantile(["x", "y"], [(i + 1) / (edges + 1) for i in range(edges)], 0.1 / (edges + 1))] if edges > 0 else [[], []]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = {}
                for name, cut in zip("xy", cuts, strict=True):
                    v, edge = b.column(name).to_numpy(), np.array(cut)
                    k = np.searchsorted(edge, v, "left")
                    at[f"{name}b"] = (2 * k + (np.append(edge, np.nan)[k] == v)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in ("x", "y", "w")}, **at})

        placed = cells.mapInArrow(place, "x double, y double, w double, xb int, yb int").persist()
        try:
            table = {(r.xb, r.yb): r.w for r in placed.groupBy("xb", "yb").agg(F.sum("w").alias("w")).collect()}  # (2 EDGES + 1) squared rows at most
            counts = np.zeros((2 * edges + 3, 2 * edges + 3))
            for at, w in table.items():
                counts[at] = w
            later = np.cumsum(counts[::-1], 0)[::-1]  # rows of a block of x and those after it
            below = np.cumsum(later, 1)
            far = float((counts[:-1, 1:] * below[1:, :-1]).sum())

            def merge(by: str, first: str) -> float:
                def count(t: pa.Table) -> pa.Table:
                    return pa.table({"k": [opposite(t.column(first).to_numpy(), t.column("y").to_numpy(), t.column("w").to_numpy())]})

                # a block of one value of its own column holds no such pair
                return placed.where(f"{by} % 2 = 0").groupBy(by).applyInArrow(count, "k double").agg(F.coalesce(F.sum("k"), F.lit(0.0)).alias("k")).first().k

            found = far + merge("xb", "x") + merge("yb", "xb")
        finally:
            placed.unpersist()
        n = cells.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("n")).first().n
        row = (float(n), float(found), *_ties(cells, "x").first(), *_ties(cells, "y").first(), _ties(cells, "x", "y").first().two)
    finally:
        cells.unpersist()
    sums = spark.createDataFrame([row], "n double, opposite double, x2 double, x3 double, x5 double, y2 double, y3 double, y5 double, both double")
    return _tested(sums, [])


def kendalls(rows: DataFrame, within: Sequence[str], x: str, y: str) -> DataFrame:
    """``within``, n, opposite, tau, z and p for each group: for many groups of a size that a task holds, such as score tables. See ``kendall_large`` for one that is larger."""
    keys = list(within)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    known = rows.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("__x IS NOT NULL AND __y IS NOT NULL AND NOT isnan(__x) AND NOT isnan(__y)")

    def ties(v: np.ndarray) -> tuple[float, float, float]:
        t = np.unique(v, return_counts=True, axis=0)[1].astype(float)
        return float((t * (t - 1) / 2).sum()), float((t * (t - 1) * (t - 2)).sum()), float((t * (t - 1) * (2 * t + 5)).sum())

    def one(t: pa.Table) -> pa.Table:
        a, b = t.column("__x").to_numpy(), t.column("__y").to_numpy()
        found = dict(zip(("n", "opposite", "x2", "x3", "x5", "y2", "y3", "y5", "both"), (float(len(a)), opposite(a, b), *ties(a), *ties(b), ties(np.stack([a, b], 1))[0]), strict=True))
        return pa.table({c: t.column(c)[:1] for c in keys} | {c: pa.array([v]) for c, v in found.items()})

    sums = known.groupBy(*keys).applyInArrow(one, f"{kinds}, n double, opposite double, x2 double, x3 double, x5 double, y2 double, y3 double, y5 double, both double")
    return _tested(sums, keys)


def _tested(sums: DataFrame, keys: list[str]) -> DataFrame:
    n, m = F.col("n"), F.col("n") * (F.col("n") - 1)
    whole = m / 2
    lead = whole - F.col("x2") - F.col("y2") + F.col("both") - 2 * F.col("opposite")
    room = (whole - F.col("x2")) * (whole - F.col("y2"))
    variance = (m * (2 * n + 5) - F.col("x5") - F.col("y5")) / 18 + 2 * F.col("x2") * F.col("y2") / F.nullif(m, F.lit(0.0)) + F.coalesce(F.col("x3") * F.col("y3") / F.nullif(9 * m * (n - 2), F.lit(0.0)), F.lit(0.0))
    least = F.least(F.col("opposite"), whole - F.col("opposite"))
    exact = (F.col("x2") == 0) & (F.col("y2") == 0) & ((n <= EXACT_TAU) | (least <= 1))
    out = sums.select(*keys, n.cast("long").alias("n"), F.col("opposite").cast("long").alias("opposite"), F.when(room > 0, lead / F.sqrt(room)).alias("tau"), F.when((room > 0) & (variance > 0), lead / F.sqrt(variance)).alias("z"), F.when(exact & (room > 0), least.cast("long")).alias("__least"))
    return _exact(out, "n", "__least", tau_tail).withColumn("p", F.coalesce("__p", two_sided(F.col("z")))).withColumn("exact", F.col("__p").isNotNull()).drop("__p", "__least")


def tau_tail(n: int, least: int) -> float:
    """Two-sided p of ``least`` inversions, or as many too few, among n rows: from the numbers of permutations of 1, 2, .. n rows with each number of inversions up to it."""
    whole = n * (n - 1) // 2
    if n < 3 or 2 * least >= whole:
        return 1.0
    share = np.zeros(least + 1)  # of permutations: no number overflows
    share[0] = 1.0
    for k in range(2, n + 1):
        upto = np.cumsum(share)
        share = (upto - np.concatenate([np.zeros(min(k, least + 1)), upto[: max(0, least + 1 - k)]])) / k
    return min(1.0, 2 * float(share.sum()))


def u_tail(n1: int, n2: int, u: int) -> float:
    """Two-sided p of the statistic U, or as far on the other side, of two samples without ties: from the numbers of choices of n1 ranks with each sum."""
    low = min(u, n1 * n2 - u)
    if n1 > n2:
        n1, n2 = n2, n1
    # ways[c][s]: choices of c of the ranks so far whose excess over the least sum is s, as a share of all choices
    ways = np.zeros((n1 + 1, low + 1))
    ways[0, 0] = 1.0
    for rank in range(1, n1 + n2 + 1):
        for c in range(min(rank, n1), 0, -1):
            step = rank - c  # the c-th smallest rank stands so far above its least place
            if step <= low:
                ways[c, step:] += ways[c - 1, : low + 1 - step]
    return min(1.0, 2 * float(ways[n1].sum()) / float(np.prod([(n2 + i) / i for i in range(1, n1 + 1)])))


def _exact(rows: DataFrame, n: str, least: str, tail: object) -> DataFrame:
    """Adds __p: the exact p where ``least`` isn't null."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [None if k is None else tail(m, k) for m, k in zip(b.column(n).to_pylist(), b.column(least).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, "__p"])

    return rows.mapInArrow(one, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", __p double")


def rank_sums(rows: DataFrame, within: Sequence[str], value: str, first: str) -> DataFrame:
    """``within``, n1, n2, u (of the rows where ``first``), ties, p and exact, two-sided, for each group (STA05).

    Exact where no value repeats and one sample has ``EXACT_U`` rows at most, else normal with tie terms and a continuity
    correction. Ranks come from counts of distinct values; a group's distinct values are ordered in one task.
    """
    keys = list(within)
    steps = rows.where(F.col(value).isNotNull() & F.col(first).isNotNull()).groupBy(*keys, value).agg(F.count_if(first).alias("a"), F.count("*").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = steps.withColumn("r", before + (F.col("t") + 1) / 2.0).groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum(F.col("t") - F.col("a")).alias("n2"), F.sum(F.col("r") * F.col("a")).alias("s"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    both = F.col("n1") * F.col("n2")
    u = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2.0
    sigma = F.sqrt(both / 12.0 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0))))
    z = (F.greatest(u, both - u) - both / 2.0 - 0.5) / F.nullif(sigma, F.lit(0.0))
    exact = (F.col("ties") == 0) & (F.least("n1", "n2") <= EXACT_U) & (both > 0)
    out = sums.select(*keys, "n1", "n2", u.alias("u"), (F.col("ties") / 6).cast("long").alias("ties"), z.alias("__z"), F.when(exact, F.struct("n1", "n2", u.cast("long").alias("u"))).alias("__c"))
    found = _exact(out.withColumn("__k", F.when(F.col("__c").isNotNull(), F.col("u").cast("long"))).drop("__c").withColumn("__n", F.concat_ws(" ", "n1", "n2")), "__n", "__k", lambda m, k: u_tail(*map(int, m.split()), k))
    # the correction can pass the middle, where p is 1
    return found.withColumn("p", F.coalesce("__p", F.when(F.col("__z") <= 0, 1.0).otherwise(two_sided(F.col("__z"))))).withColumn("exact", F.col("__p").isNotNull()).drop("__p", "__k", "__n", "__z")
