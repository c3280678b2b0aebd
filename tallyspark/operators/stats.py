"""Rank correlations by group, and their resampling (STA, BOO)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import keyed


def spearman(rows: DataFrame, within: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """``within``, n, rho: Pearson's correlation of mean ranks; null for fewer than ``least`` rows or without variance."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    mean_rank = lambda c: F.rank().over(Window.partitionBy(*within).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*within, c)) - 1) / 2
    ranked = known.withColumn("rx", mean_rank(x)).withColumn("ry", mean_rank(y))
    out = ranked.groupBy(*within).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))
    return out.withColumn("rho", F.when(F.col("n") >= least, F.nanvl("rho", F.lit(None).cast("double"))))


def kendall(rows: DataFrame, within: Sequence[str], item: str, x: str, y: str) -> DataFrame:
    """``within``, tau (tau-b), from all pairs of items of a group: for score tables, whose items are few."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*within, item, x, y)
    a, b = known.toDF(*within, "i", "x1", "y1"), known.toDF(*within, "j", "x2", "y2")
    pairs = (a.join(b, list(within)) if within else a.crossJoin(b)).where(F.col("i") < F.col("j"))
    sx, sy = F.signum(F.col("x1") - F.col("x2")), F.signum(F.col("y1") - F.col("y2"))
    sums = pairs.groupBy(*within).agg(F.sum(sx * sy).alias("s"), F.sum(sx * sx).alias("nx"), F.sum(sy * sy).alias("ny"))
    return sums.select(*within, F.when((F.col("nx") > 0) & (F.col("ny") > 0), F.col("s") / F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"))


def draws(units: DataFrame, unit: str, n: int, seed: int, salt: str) -> DataFrame:
    """draw, ``unit``, times: ``n`` samples with replacement, each as large as ``units``; units not drawn are absent."""
    numbered = units.select(unit).distinct().withColumn("slot", F.row_number().over(Window.orderBy(unit)) - 1)
    size = numbered.agg(F.count("*").alias("size"))
    slots = numbered.select("slot").crossJoin(units.sparkSession.range(n).withColumnRenamed("id", "draw")).crossJoin(F.broadcast(size))
    picked = slots.withColumn("pick", (keyed(seed, salt, "draw", "slot") % F.col("size")).cast("int"))
    return picked.groupBy("draw", "pick").agg(F.count("*").alias("times")).join(numbered.withColumnRenamed("slot", "pick"), "pick").select("draw", unit, "times")


def draws_sql(units: str, unit: str, n: int, seed: int, salt: str) -> str:
    from ..functions.keyed import keyed_sql

    return f"""numbered AS (SELECT {unit}, row_number() OVER (ORDER BY {unit}) - 1 AS slot FROM (SELECT DISTINCT {unit} FROM {units})),
picks AS (SELECT d.draw, {keyed_sql(seed, salt, "d.draw", "n.slot")} % (SELECT count(*) FROM numbered) AS pick FROM numbered n CROSS JOIN (SELECT unnest(range({n})) AS draw) d),
draws AS (SELECT draw, {unit}, count(*) AS times FROM picks JOIN numbered ON pick = slot GROUP BY draw, {unit})"""


def interval(rows: DataFrame, within: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """``within``, lo, hi: percentiles of ``value`` over draws, interpolated."""
    tail = (1 - level) / 2
    return rows.groupBy(*within).agg(F.percentile(value, tail).alias("lo"), F.percentile(value, 1 - tail).alias("hi"))


def permuted(rows: DataFrame, item: str, x: str, y: str, n: int, seed: int, salt: str = "perm") -> DataFrame:
    """n_items, rho, p of Spearman's correlation: p is (1 + permutations of ``y`` at least as far from 0) / (n + 1).

    Items are those of a score table, so few; permutations are spread over tasks.
    """
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    mean_rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2
    ranked = known.select(F.col(item).alias("item"), mean_rank(x).alias("rx"), mean_rank(y).alias("ry"), F.row_number().over(Window.orderBy(item)).alias("slot"))
    dealt = ranked.select("item", "rx").crossJoin(rows.sparkSession.range(n).withColumnRenamed("id", "draw"))
    dealt = dealt.withColumn("slot", F.row_number().over(Window.partitionBy("draw").orderBy(keyed(seed, salt, "draw", "item"), "item")))
    each = dealt.join(ranked.select("slot", "ry"), "slot").groupBy("draw").agg(F.round(F.corr("rx", "ry"), 9).alias("b"))
    seen = ranked.agg(F.count("*").alias("n_items"), F.round(F.corr("rx", "ry"), 9).alias("rho"))
    return each.crossJoin(F.broadcast(seen)).groupBy("n_items", "rho").agg(((1 + F.count_if(F.abs("b") >= F.abs("rho"))) / F.lit(n + 1.0)).alias("p"))


#: Abramowitz and Stegun 7.1.26, fixed values; the error is below 1.5e-7.
ERFC_P = 0.3275911
ERFC_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_sided(z: Column) -> Column:
    """The normal distribution's weight beyond ``z`` on both sides."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + ERFC_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERFC_A):
        poly = (poly + a) * t
    return poly * F.exp(-x * x)


def two_sided_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {ERFC_P}::DOUBLE * {x}))"
    poly = "0.0::DOUBLE"
    for a in reversed(ERFC_A):
        poly = f"(({poly} + ({a}::DOUBLE)) * {t})"
    return f"({poly} * exp(-{x} * {x}))"


def spearman_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation of n >= 3 rows by Student's t with n - 2 degrees, from the finite series for whole degrees; null for null.

    The tangent of the angle is t / sqrt(degrees), so its sine is ``rho`` itself. Cancellation leaves p exact to some 1e-15.
    """
    nu = n - 2
    sine, cosine2 = F.abs(rho), 1 - rho * rho
    odd = F.pmod(nu, F.lit(2)) == 1
    # each term is the one before times cos^2 * 2j / (2j + 1), or for even degrees (2j - 1) / 2j
    last = F.when(odd, (nu - 3) / 2).otherwise((nu - 2) / 2).cast("int")
    factor = lambda j: F.when(odd, 2.0 * j / (2.0 * j + 1)).otherwise((2.0 * j - 1) / (2.0 * j))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(x: Column, j: Column) -> Column:
        term = x["term"] * cosine2 * factor(j)
        return F.struct(term.alias("term"), (x["total"] + term).alias("total"))

    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(steps, start, add)["total"]
    angle = F.asin(F.least(sine, F.lit(1.0)))
    beyond_one = F.when(nu > 1, sine * F.sqrt(cosine2) * series).otherwise(F.lit(0.0))
    p = F.greatest(F.lit(0.0), 1 - F.when(odd, 2 / F.lit(math.pi) * (angle + beyond_one)).otherwise(sine * series))
    return F.when(rho.isNotNull() & n.isNotNull(), p)


def spearman_p_sql(rho: str, n: str) -> str:
    """The same in DuckDB, to six places, with the terms' factors as gamma functions."""
    c2 = f"(1 - {rho} * {rho})"
    odd = f"list_sum(list_transform(range(0, greatest(0, ({n} - 3) // 2)), lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * {c2} ** j))"
    even = f"list_sum(list_transform(range(0, ({n} - 2) // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * {c2} ** j))"
    return f"CASE WHEN {rho} IS NOT NULL THEN round(greatest(0, 1 - CASE WHEN {n} % 2 = 1 THEN 2 / pi() * (asin(least(abs({rho}), 1)) + coalesce(abs({rho}) * sqrt({c2}) * {odd}, 0)) ELSE abs({rho}) * {even} END), 6) END"


def mann_whitney(rows: DataFrame, value: str, first: str) -> DataFrame:
    """n1, n2, u (of the rows where ``first``), z and two-sided p by the normal approximation with ties.

    Ranks come from counts of distinct values, so what is ordered is as large as these are.
    """
    steps = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(first).alias("a"), F.count("*").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = steps.withColumn("r", before + (F.col("t") + 1) / 2.0).agg(F.sum("a").alias("n1"), F.sum(F.col("t") - F.col("a")).alias("n2"), F.sum(F.col("r") * F.col("a")).alias("s"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    u = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2.0
    sigma = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    out = sums.select("n1", "n2", u.alias("u"), ((u - F.col("n1") * F.col("n2") / 2.0) / F.nullif(sigma, F.lit(0.0))).alias("z"))
    return out.withColumn("p", two_sided(F.col("z")))
