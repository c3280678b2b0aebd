"""Reranking candidates against plain loops."""

import random

import pytest
from pyspark.sql import functions as F
from tallyspark.functions.keyed import keyed
from tallyspark.operators import rerank

SEED = 13


def brute(rows, keys, n_queries, n_hard, n_easy, apart):
    known = [r for r in rows if None not in r]
    holders = {}
    for i, h, k in known:
        holders.setdefault(k, set()).add(h)
    order = lambda salt: sorted(known, key=lambda r: (keys[salt][r[0]], r[0]))
    out = {}
    for i, h, k in [r for r in order("rerank") if len(holders[r[2]]) > 1][:n_queries]:
        found = {x: 1 for x, hx, kx in known if kx == k and hx != h}
        ring = [r for r in order("hard") if r[1] == h]
        at = keys["start"][i] % len(ring)
        hard = [x for x, _, kx in ring[at:] + ring[:at] if (kx != k if apart else x != i)][:n_hard]
        every = order("easy")
        at = keys["any"][i] % len(every)
        easy = [x for x, _, _ in (every[at:] + every[:at])[:n_easy] if x != i]
        for x in hard + easy:
            found.setdefault(x, 0)
        if 0 in found.values():
            out |= {(i, x): rel for x, rel in found.items()}
    return out


@pytest.mark.parametrize(("n_queries", "n_hard", "n_easy", "apart"), [(10, 5, 7, False), (10, 5, 7, True), (500, 3, 0, True), (500, 400, 400, False)])
def test_candidates(spark, n_queries, n_hard, n_easy, apart):
    rng = random.Random(n_hard)
    rows = [(i, rng.choice("aaab"), f"k{rng.randrange(25)}") for i in range(120)] + [(900, "solo", "k1"), (901, None, "k1"), (902, "a", None)]
    table = spark.createDataFrame(rows, "id long, h string, k string").repartition(4)
    keys = {s: {r.id: r.x for r in table.select("id", keyed(SEED, s, "id").alias("x")).collect()} for s in ("rerank", "hard", "start", "easy", "any")}
    found = rerank.candidates(table, "k", "h", "id", n_queries, n_hard, n_easy, SEED, apart)
    want = brute(rows, keys, n_queries, n_hard, n_easy, apart)
    assert {(r.qid, r.did): r.rel for r in found.collect()} == want and found.count() == len(want)
    corpus = {r.id: r for r in rerank.closure(found).collect()}
    assert set(corpus) == {i for pair in want for i in pair} and {i for i, r in corpus.items() if r.is_query} == {q for q, _ in want}
    assert all(r.n_lists == sum(d == i for _, d in want) and r.n_positive == sum(rel for (q, _), rel in want.items() if q == i) for i, r in corpus.items())
    bits = rerank.bitmaps(found, rerank.closure(found), SEED).select("qid", F.expr("bitmap_count(members)").alias("n"), F.expr("bitmap_count(relevant)").alias("p")).collect()
    assert {r.qid: (r.n, r.p) for r in bits} == {q: (sum(a == q for a, _ in want), sum(rel for (a, _), rel in want.items() if a == q)) for q, _ in want}


def test_numbers_are_places_in_the_keyed_order(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("g")).repartition(5)
    for within in ((), ("g",)):
        got = rerank.numbered(rows, keyed(1, "x", "id"), "id", *within).withColumn("key", keyed(1, "x", "id")).collect()
        groups = {}
        for r in got:
            groups.setdefault(r.g if within else 0, []).append(r)
        for members in groups.values():
            assert [r.place for r in sorted(members, key=lambda r: (r.key, r.id))] == list(range(len(members))) and {r.size for r in members} == {len(members)}


def test_nothing_to_rank(spark):
    rows = spark.createDataFrame([(1, "a", "k"), (2, "a", "k")], "id long, h string, k string")
    assert rerank.candidates(rows, "k", "h", "id", 10, 5, 5, SEED, True).count() == 0
