"""Pairs of the n-gram join are sieved by parity bits that fit their sizes, and texts that meet often are sent together."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyspark.llm import jaccard


def _words(seed: int, n: int) -> list[str]:
    return [f"w{random.Random(f'{seed} {i}').randrange(10**9)}" for i in range(n)]


def test_long_texts_without_links_are_sieved_out_and_no_link_is_lost(spark):
    base = _words(0, 1500)
    texts = {i: " ".join(_words(i, 1500)) for i in range(1, 9)}  # 512 bits say nothing of these
    texts |= {20: " ".join(base), 21: " ".join(base[:-40] + _words(21, 40)), 22: " ".join(_words(22, 6)), 23: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    profile = jaccard.kept(jaccard.profiles(docs, "text", 5))
    ids = spark.createDataFrame([(i,) for i in texts], "v long")
    pairs = ids.select(F.col("v").alias("a")).crossJoin(ids.select(F.col("v").alias("b"))).where("a < b")
    left = {(r.a, r.b) for r in jaccard.sieved(pairs, profile, 75, 100).collect()}
    assert left == {(20, 21)}
    assert {(r.a, r.b) for r in jaccard.linked(pairs, profile, docs, "text", 5, 75, 100).collect()} == {(20, 21)}


def test_bits_fold_onto_fewer(spark):
    docs = spark.createDataFrame([(1, " ".join(_words(1, 400))), (2, " ".join(_words(1, 400)[:300]))], "doc_id long, text string")
    a, b = (r.fine for r in jaccard.profiles(docs, "text", 5).orderBy("doc_id").collect())
    assert len(a) == len(b) * 1 or len(a) == 2 * len(b)
    assert jaccard.differing(a, b) == jaccard.differing(b, a) <= 100
    assert jaccard.differing(a, a) == 0


def test_texts_that_all_meet_are_sent_once_a_block(spark):
    n = 400
    pairs = spark.range(n).withColumnRenamed("id", "a").crossJoin(spark.range(n).withColumnRenamed("id", "b")).where("a < b")
    dealt = jaccard.dealt_out(pairs, 80, side=100).cache()
    assert dealt.count() == n * (n - 1) // 2
    sent = dealt.select(F.explode(F.array("a", "b")).alias("v"), "part").distinct().count()
    assert sent <= n * 6  # with pairs dealt out by their first text: about 80 times each


def test_copies_are_not_indexed_and_keep_their_links(spark, monkeypatch):
    base = _words(3, 60)
    texts = [(i, " ".join(base if i % 2 else [*base[:-2], "x", "y"])) for i in range(1, 41)] + [(50, " ".join(_words(50, 30))), (7, " ".join(_words(50, 30))), (60, ""), (None, " ".join(base))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)  # copies lie in different tasks
    want = {(i, 1 if i is not None and i < 60 else i) for i, _ in texts}
    seen = []
    index = jaccard.index
    monkeypatch.setattr(jaccard, "index", lambda rows, *a: seen.append(sorted(r.doc_id for r in rows.where("text <> '' AND doc_id IS NOT NULL").collect())) or index(rows, *a))
    for ids, kept in ((100, [1, 2, 7, 7]), (10, [1, 2, 7, 7]), (1, sorted(i for i, t in texts if t and i))):  # those that go are sent, those that stay, neither
        monkeypatch.setattr(jaccard, "IDS", ids)
        assert {(r.doc_id, r.component_id) for r in jaccard.join(docs).collect()} == want
        assert seen.pop() == kept
