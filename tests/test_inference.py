"""Tests of significance, linkage, probes, the registry and arriving scores on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyspark import registry
from tallyspark.operators import linkage, probes, stats
from tallyspark.streaming import scores


def test_rank_sum(spark):
    rows = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (3.0, False), (4.0, False), (None, True)], "v double, a boolean")
    r = stats.mann_whitney(rows, "v", "a").collect()[0]
    assert (r.n1, r.n2, r.u) == (2, 3, 0.5)
    assert r.z == pytest.approx(-2.5 / np.sqrt(0.5 * (6 - 6 / 20)))
    same = spark.createDataFrame([(1.0, True), (1.0, False)], "v double, a boolean")
    assert stats.mann_whitney(same, "v", "a").collect()[0].z is None


def test_normal_tail(spark):
    got = [r.p for r in spark.createDataFrame([(0.0,), (1.0,), (-1.96,)], "z double").select(stats.two_sided(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([1.0, 0.3173105, 0.0499958], abs=1e-6)


def test_permutation_of_equal_orders(spark):
    rows = spark.createDataFrame([(str(i), float(i), float(i)) for i in range(8)], "m string, x double, y double")
    r = stats.permuted(rows, "m", "x", "y", 99, 5).collect()[0]
    assert (r.n_items, r.rho) == (8, 1.0) and r.p <= 0.02


def test_average_linkage_against_brute_force():
    rng = np.random.default_rng(3)
    d = rng.random((9, 9))
    d = (d + d.T) / 2
    groups = [[i] for i in range(9)]
    while len(groups) > 4:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: np.mean([d[a, b] for a in groups[p[0]] for b in groups[p[1]]]))
        groups[i] += groups.pop(j)
    want = [0] * 9
    for number, members in enumerate(sorted(groups, key=min), 1):
        for m in members:
            want[m] = number
    assert linkage.merges(d, (4,))[4] == want


def test_linkage_of_a_missing_pair(spark):
    pairs = spark.createDataFrame([("a", "b", 0.1), ("b", "c", None)], "a string, b string, d double")
    got = {(r.item, r.k): r.cluster for r in linkage.linked(pairs, "a", "b", "d", (2, 5)).collect()}
    assert got == {("a", 5): 1, ("b", 5): 2, ("c", 5): 3, ("a", 2): 1, ("b", 2): 1, ("c", 2): 2}


def test_probe_and_clusters_of_apart_labels(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, float(i % 3), [float(x) for x in rng.normal(size=4) + 20 * np.eye(4)[i % 3]]) for i in range(90)], "id long, y double, vec array<double>")
    r = probes.probe_scores(probes.halves(rows, "y", "id", 0), "y").collect()[0]
    assert (r.n_train, r.n_test, r.accuracy) == (63, 27, 1.0) and r.loss_after < r.loss_before
    assert probes.cluster_scores(rows, "y", (1,), starts=3).collect()[0].ari == pytest.approx(1)
    assert probes.shots(rows, "y", "id", 0).where("NOT test").count() == 24


def test_registry(spark):
    def broken(spark, rows):
        raise ValueError("no")

    r = registry.Registry()
    a, b = r.add(registry.Task("a", "one", lambda s, e: e.count())), r.add(registry.Task("b", "two", broken, default=False))
    assert r.add(a) is a and r.select() == [a] and r.select(["b", "a", "b"]) == [b, a] and r.select(categories=["two"]) == [b]
    with pytest.raises(KeyError):
        r.get("c")
    with pytest.raises(KeyError):
        r.select(categories=["three"])
    with pytest.raises(ValueError):
        r.add(registry.Task("a", "two", broken))
    got = registry.run(spark, "m", spark.range(5), r.select(["a", "b"]))
    assert [(x.task, x.score, x.status) for x in got.collect()] == [("a", 5.0, "ok"), ("b", None, "failed")]
    again = registry.run(spark, "m", spark.range(7), [a], done=got)
    assert again.collect()[0].status == "kept" and again.collect()[0].score == 5.0
    with pytest.raises(ValueError):
        registry.run(spark, "m", spark.range(5), [b], raise_error=True)
    assert registry.complete(got, 2).collect()[0].is_complete is False and r.described(spark).count() == 2
    models = spark.createDataFrame([("x", 1), ("y", 2)], "model string, n int")
    once = registry.upserted(models, spark.createDataFrame([("y", 3), ("z", 4)], "model string, n int"))
    assert sorted(map(tuple, once.collect())) == [("x", 1), ("y", 3), ("z", 4)]


def test_arriving_scores(spark, tmp_path):
    def put(revision, value):
        at = tmp_path / "in" / "org__name" / revision
        at.mkdir(parents=True, exist_ok=True)
        (at / "T.json").write_text(json.dumps({"task_name": "T", "scores": {"test": [{"main_score": value, "hf_subset": "x"}]}}))

    seen = []
    put("r1", 0.1)
    go = lambda: scores.refreshed(scores.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "at"), lambda rows: seen.append(rows.count())).awaitTermination()
    go()
    put("r2", 0.2)
    go()
    go()
    assert seen == [1, 2]
    assert sorted(r.score for r in scores.latest(spark, str(tmp_path / "out")).collect()) == [0.1, 0.2]
