"""Inversions, tau and exact tests against all pairs and all permutations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyspark.operators import ranks, stats


def pairs(x, y):
    return sum(x[i] < x[j] and y[i] > y[j] for i in range(len(x)) for j in range(len(x)))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 100])
@pytest.mark.parametrize("values", [3, 10, 10_000])
def test_inversions_are_pairs(n, values):
    rng = np.random.default_rng(n + values)
    x, y, w = rng.integers(0, values, n), rng.integers(0, values, n) - 5, rng.integers(1, 4, n)
    assert ranks.opposite(x, y) == pairs(x, y)
    assert ranks.opposite(x, y, w) == pairs(np.repeat(x, w), np.repeat(y, w))


@pytest.mark.parametrize("n", range(1, 9))
def test_tau_tail_is_that_of_all_permutations(n):
    whole = n * (n - 1) // 2
    counts = [pairs(range(n), p) for p in itertools.permutations(range(n))] if n < 8 else None
    for k in range(whole + 1):
        least = min(k, whole - k)
        if counts:
            want = 1.0 if 2 * least == whole else sum(c <= least or c >= whole - least for c in counts) / len(counts)
            assert ranks.tau_tail(n, least) == pytest.approx(min(1.0, want))
    assert ranks.tau_tail(8, 0) == pytest.approx(2 / math.factorial(8)) and ranks.tau_tail(33, 10) > 0


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (1, 5), (3, 4), (4, 3), (5, 3), (2, 6)])
def test_u_tail_is_that_of_all_choices(n1, n2):
    got = [sum(r - i for i, r in enumerate(c)) for c in itertools.combinations(range(n1 + n2), n1)]
    for u in range(n1 * n2 + 1):
        low = min(u, n1 * n2 - u)
        want = sum(g <= low for g in got) / len(got) + sum(g >= n1 * n2 - low for g in got) / len(got)
        assert ranks.u_tail(n1, n2, u) == pytest.approx(min(1.0, want))


@pytest.mark.parametrize("values", [4, 40, 10**9])
@pytest.mark.parametrize("block", [5, 40, 10**6])
def test_large_tau_is_that_of_pairs(spark, values, block):
    rng = np.random.default_rng(values % 1000 + block)
    x = rng.integers(0, values, 150)
    x[:50] = 2  # a third of the rows share a value
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, rng.integers(0, values, 150) + x // 2, strict=True))] + [(900, None, 1.0), (901, float("nan"), 1.0)], "i int, x double, y double").repartition(5)
    r = ranks.kendall_large(rows, "x", "y", block).collect()[0]
    good = rows.where("x IS NOT NULL AND NOT isnan(x)")
    a, b = zip(*[(q.x, q.y) for q in good.collect()], strict=True)
    assert r.n == 150 and r.opposite == pairs(a, b)
    assert r.tau == pytest.approx(stats.kendall(good, [], "i", "x", "y").collect()[0].tau)
    s = ranks.kendalls(good.withColumn("g", F.lit("one")), ["g"], "x", "y").collect()[0]
    assert (s.n, s.opposite, s.tau, s.z, s.p) == pytest.approx((r.n, r.opposite, r.tau, r.z, r.p)) and not r.exact


def test_tau_of_odd_groups(spark):
    rows = spark.createDataFrame([("up", float(i), float(i)) for i in range(6)] + [("flat", 1.0, float(i)) for i in range(4)] + [("one", 1.0, 1.0)], "g string, x double, y double")
    got = {r.g: r for r in ranks.kendalls(rows, ["g"], "x", "y").collect()}
    assert (got["up"].tau, got["up"].exact) == (1.0, True) and got["up"].p == pytest.approx(2 / 720)
    assert got["flat"].tau is None and got["one"].tau is None and got["flat"].p is None
    empty = ranks.kendall_large(rows.where("1 = 0"), "x", "y").collect()[0]
    assert (empty.n, empty.tau, empty.p) == (0, None, None)


def test_rank_sums(spark):
    rng = np.random.default_rng(8)
    rows = [("apart", float(i), i < 4) for i in range(9)] + [("ties", float(rng.integers(4)), i % 3 == 0) for i in range(30)] + [("large", float(v), i % 2 == 0) for i, v in enumerate(rng.normal(size=40))] + [("alone", 1.0, True)]
    got = {r.g: r for r in ranks.rank_sums(spark.createDataFrame([*rows, ("apart", None, True)], "g string, v double, a boolean"), ["g"], "v", "a").collect()}
    assert (got["apart"].n1, got["apart"].n2, got["apart"].u, got["apart"].exact) == (4, 5, 0.0, True) and got["apart"].p == pytest.approx(2 / math.comb(9, 4))
    assert not got["ties"].exact and got["ties"].ties > 0 and not got["large"].exact and not got["alone"].exact
    for g in ("ties", "large"):
        a, b = ([r[1] for r in rows if r[0] == g and r[2] == side] for side in (True, False))
        u = sum((x > y) + (x == y) / 2 for x in a for y in b)
        n, t = len(a) + len(b), np.unique(a + b, return_counts=True)[1]
        s = math.sqrt(len(a) * len(b) / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1))))
        z = (max(u, len(a) * len(b) - u) - len(a) * len(b) / 2 - 0.5) / s
        assert got[g].u == u and got[g].p == pytest.approx(1.0 if z <= 0 else math.erfc(z / math.sqrt(2)), abs=1e-6)
