"""Agreement of two labellings from their contingency table (AGG13, CLU02-06): no pair of rows is built."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written


def contingency(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """u (truth), v (found), n, with margins a and b and the total."""
    cells = rows.groupBy(F.col(truth).alias("u"), F.col(found).alias("v")).agg(F.count("*").cast("double").alias("n"))
    whole = cells.agg(F.sum("n").alias("total"))
    a, b = cells.groupBy("u").agg(F.sum("n").alias("a")), cells.groupBy("v").agg(F.sum("n").alias("b"))
    return cells.join(a, "u").join(b, "v").crossJoin(F.broadcast(whole))


def scores(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """n_rows, mi, homogeneity, completeness, v_measure, ari, purity. A labelling with one class has entropy 0 and counts as matched in full."""
    cells = contingency(rows, truth, found)
    one = lambda x: x * (x - 1) / 2
    n, t = F.col("n"), F.col("total")
    u = cells.select("u", "a", "total").distinct().agg(F.sum(-(F.col("a") / t) * F.log(F.col("a") / t)).alias("hu"), F.sum(one(F.col("a"))).alias("pu"))
    v = cells.select("v", "b", "total").distinct().agg(F.sum(-(F.col("b") / t) * F.log(F.col("b") / t)).alias("hv"), F.sum(one(F.col("b"))).alias("pv"))
    best = cells.groupBy("v").agg(F.max("n").alias("top")).agg(F.sum("top").alias("tops"))
    both = cells.agg(F.max("total").alias("total"), F.sum(n / t * F.log(n * t / (F.col("a") * F.col("b")))).alias("mi"), F.sum(one(n)).alias("pairs"))
    row = both.crossJoin(u).crossJoin(v).crossJoin(best)
    row = row.withColumn("h", F.when(F.col("hu") <= 0, 1.0).otherwise(F.col("mi") / F.col("hu"))).withColumn("c", F.when(F.col("hv") <= 0, 1.0).otherwise(F.col("mi") / F.col("hv")))
    expected = F.col("pu") * F.col("pv") / one(t)
    return row.select(
        t.cast("long").alias("n_rows"), "mi", F.col("h").alias("homogeneity"), F.col("c").alias("completeness"),
        F.when(F.col("h") + F.col("c") == 0, 0.0).otherwise(2 * F.col("h") * F.col("c") / (F.col("h") + F.col("c"))).alias("v_measure"),
        F.when((F.col("pu") + F.col("pv")) / 2 == expected, 1.0).otherwise((F.col("pairs") - expected) / ((F.col("pu") + F.col("pv")) / 2 - expected)).alias("ari"),
        (F.col("tops") / t).alias("purity"),
    )


def log_factorial(k: Column) -> Column:
    """ln k! for k >= 0 by Stirling's series, shifted up by 8 places; right to some 1e-12."""
    x = k.cast("double") + 1
    z = x + 8
    shift = reduce(lambda p, j: p * (x + j), range(1, 8), x)  # one logarithm for all eight places
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(shift)


def adjusted_mi(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """ami: mutual information less what random labellings with these margins share (hypergeometric), over the mean entropy less the same.

    Expected values are summed over distinct pairs of margins.
    """
    cells = contingency(rows, truth, found)
    size = cells.select("total").limit(1)
    a = cells.select("u", "a").distinct().groupBy("a").agg(F.count("*").alias("na"))
    b = cells.select("v", "b").distinct().groupBy("b").agg(F.count("*").alias("nb"))
    grid = a.crossJoin(b).crossJoin(F.broadcast(size))
    grid = grid.withColumn("k", F.explode(F.sequence(F.greatest(F.lit(1.0), F.col("a") + F.col("b") - F.col("total")).cast("int"), F.least("a", "b").cast("int"))))
    lf = log_factorial
    A, B, T, K = F.col("a"), F.col("b"), F.col("total"), F.col("k").cast("double")
    p = F.exp(lf(A) + lf(B) + lf(T - A) + lf(T - B) - lf(T) - lf(K) - lf(A - K) - lf(B - K) - lf(T - A - B + K))
    emi = grid.agg(F.sum(F.col("na") * F.col("nb") * K / T * F.log(T * K / (A * B)) * p).alias("emi"))
    base = scores(rows, truth, found)
    hu = cells.select("u", "a", "total").distinct().agg(F.sum(-(A / T) * F.log(A / T)).alias("hu"))
    hv = cells.select("v", "b", "total").distinct().agg(F.sum(-(B / T) * F.log(B / T)).alias("hv"))
    return base.crossJoin(emi).crossJoin(hu).crossJoin(hv).select(((F.col("mi") - F.col("emi")) / ((F.col("hu") + F.col("hv")) / 2 - F.col("emi"))).alias("ami"))


def by_group(rows: DataFrame, within: list[str], truth: str, found: str, weight: str | None = None) -> DataFrame:
    """``within``, n_rows, nmi, v_measure, ari, ami and purity for each group, all from one contingency table, which is written once.

    ``weight``: how many rows a row stands for.

    nmi divides by the mean of both entropies. Expected mutual information is summed over the overlaps that a pair of
    margins has with some chance, by as many tasks as a shuffle has: 40 deviations and 40 rows around the mean leave out less than 1e-20.
    """
    n = F.sum(weight) if weight else F.count("*")
    cells = written(rows.groupBy(*within, F.col(truth).alias("u"), F.col(found).alias("v")).agg(n.cast("double").alias("n")))
    one = lambda x: x * (x - 1) / 2
    a, b = cells.groupBy(*within, "u").agg(F.sum("n").alias("a")), cells.groupBy(*within, "v").agg(F.sum("n").alias("b"), F.max("n").alias("top"))
    size = cells.groupBy(*within).agg(F.sum("n").alias("t"))
    entropy = lambda x: F.sum(-(F.col(x) / F.col("t")) * F.log(F.col(x) / F.col("t")))
    left = a.join(size, within).groupBy(*within).agg(entropy("a").alias("hu"), F.sum(one(F.col("a"))).alias("pu"))
    right = b.join(size, within).groupBy(*within).agg(entropy("b").alias("hv"), F.sum(one(F.col("b"))).alias("pv"), F.sum("top").alias("tops"))
    whole = cells.join(a, [*within, "u"]).join(b, [*within, "v"]).join(size, within)
    n, t = F.col("n"), F.col("t")
    whole = whole.groupBy(*within).agg(F.max("t").alias("t"), F.sum(n / t * F.log(n * t / (F.col("a") * F.col("b")))).alias("mi"), F.sum(one(n)).alias("pairs"))
    grid = a.groupBy(*within, "a").agg(F.count("*").alias("na")).join(b.groupBy(*within, "b").agg(F.count("*").alias("nb")), within).join(size, within)
    A, B, K = F.col("a"), F.col("b"), F.col("k").cast("double")
    mean = A * B / t
    room = 40 * F.sqrt(mean * (t - A) * (t - B) / (t * F.greatest(t - 1, F.lit(1.0)))) + 40
    low = F.greatest(F.lit(1.0), A + B - t, F.floor(mean - room).cast("double"))
    high = F.least(A, B, F.ceil(mean + room).cast("double"))
    lf = log_factorial
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fixed = grid.withColumn("fixed", lf(A) + lf(B) + lf(t - A) + lf(t - B) - lf(t)).withColumns({"low": low, "high": high}).where("low <= high")
    grid = fixed.repartition(parts, *within, "a", "b").withColumn("k", F.explode(F.sequence(F.col("low").cast("long"), F.col("high").cast("long"))))
    p = F.exp(F.col("fixed") - lf(K) - lf(A - K) - lf(B - K) - lf(t - A - B + K))
    emi = grid.groupBy(*within).agg(F.sum(F.col("na") * F.col("nb") * K / t * F.log(t * K / (A * B)) * p).alias("emi"))
    row = whole.join(left, within).join(right, within).join(emi, within, "left").withColumn("emi", F.coalesce("emi", F.lit(0.0)))
    h, c = F.when(F.col("hu") <= 0, 1.0).otherwise(F.col("mi") / F.col("hu")), F.when(F.col("hv") <= 0, 1.0).otherwise(F.col("mi") / F.col("hv"))
    half, expected = (F.col("hu") + F.col("hv")) / 2, F.col("pu") * F.col("pv") / one(t)
    alike = (F.col("pu") + F.col("pv")) / 2
    return row.withColumn("h", h).withColumn("c", c).select(
        *within, t.cast("long").alias("n_rows"), F.when(half <= 0, 1.0).otherwise(F.col("mi") / half).alias("nmi"),
        F.when(F.col("h") + F.col("c") == 0, 0.0).otherwise(2 * F.col("h") * F.col("c") / (F.col("h") + F.col("c"))).alias("v_measure"),
        F.when((t < 2) | (alike == expected), 1.0).otherwise((F.col("pairs") - expected) / (alike - expected)).alias("ari"),
        F.when(half - F.col("emi") == 0, 1.0).otherwise((F.col("mi") - F.col("emi")) / (half - F.col("emi"))).alias("ami"), (F.col("tops") / t).alias("purity"),
    )
