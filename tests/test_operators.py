"""Operators on tables small enough to work out by hand."""

import json

import pytest
from pyspark.sql import functions as F
from tallyspark.functions import vectors as V
from tallyspark.functions.keyed import keyed
from tallyspark.operators import agreement, ranking, retrieval, sampling, stats
from tallyspark.sources import results, texts


def test_borda_counts_all_models(spark):
    rows = spark.createDataFrame([("a", "t", 3.0), ("b", "t", 3.0), ("c", "u", 1.0)], "model string, task string, score double")
    got = {r.model: (r.points, r.rank) for r in ranking.borda(rows).collect()}
    assert got == {"a": (1.5, 2), "b": (1.5, 2), "c": (2.0, 1)}


def test_last_known_skips_nulls(spark):
    rows = spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, None)], "k string, s double, side string")
    assert ranking.last_known(rows, ["k"], "s", ["side"]).collect()[0] == ("a", 2.0, "x")


def test_spearman_and_kendall(spark):
    rows = spark.createDataFrame([("g", i, float(i), float(y)) for i, y in enumerate([1, 2, 2, 4])], "g string, i int, x double, y double")
    assert stats.spearman(rows, ["g"], "x", "y").collect()[0].rho == pytest.approx(0.9486833)
    assert stats.kendall(rows, ["g"], "i", "x", "y").collect()[0].tau == pytest.approx(0.9128709)
    assert stats.spearman(rows.where("i < 2"), ["g"], "x", "y").collect()[0].rho is None


def test_agreement(spark):
    same = spark.createDataFrame([(i % 3, (i % 3) * 7) for i in range(30)], "u int, v int")
    r = agreement.scores(same, "u", "v").collect()[0]
    assert (r.v_measure, r.ari, r.purity) == (pytest.approx(1), pytest.approx(1), 1.0)
    assert agreement.adjusted_mi(same, "u", "v").collect()[0].ami == pytest.approx(1)


def test_average_precision_groups_ties(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "score double, label int")
    assert retrieval.average_precision(rows).collect()[0].ap == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0, float("nan")],)], "v array<double>").select(V.n_bad(F.col("v")).alias("n"), V.unit(V.scrubbed(F.col("v"))).alias("u")).collect()[0]
    assert row.n == 1 and row.u == [0.6, 0.8, 0.0]


def test_result_documents(spark, tmp_path):
    at = tmp_path / "results" / "org__name" / "rev1"
    at.mkdir(parents=True)
    entry = lambda x, s: {"main_score": x, "hf_subset": s, "scores_per_experiment": [{"accuracy": 1.0}, {"accuracy": 3.0}]}
    (at / "T.json").write_text(json.dumps({"task_name": "T", "scores": {"train": [entry(0.1, "x")], "test": [entry(0.2, "a"), entry(0.4, "b")]}}))
    (at / "U.json").write_text(json.dumps({"task_name": "U"}))
    (at / "model_meta.json").write_text(json.dumps({"name": "x"}))
    rows = results.read_results(spark, str(tmp_path)).cache()
    assert {(r.model, r.revision, r.task) for r in rows.collect()} == {("org/name", "rev1", "T")}
    assert rows.first().dispersion == pytest.approx(2**0.5)
    assert results.by_policy(rows, "first").collect()[0].score == 0.2
    assert results.by_policy(rows, "mean").collect()[0].score == pytest.approx(30)
    assert results.by_policy(rows, "all").count() == 3


def test_transcripts(spark):
    lines = spark.createDataFrame([('( utt_1 " some text " )',), ("nothing",)], "value string")
    assert [tuple(r) for r in texts.line_transcripts(lines).collect()] == [("utt_1", "some text")]
    tabs = spark.createDataFrame([("u\ts\tt",), ("u\ts",)], "value string")
    assert [tuple(r) for r in texts.tab_transcripts(tabs).collect()] == [("u", "s", "t")]


def test_samplers_at_the_reference_sizes(spark):
    from tallyspark.plans import catalog

    q, at = catalog.queries(), "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "source").collect()
    source = {r.doc_id: r.source for r in docs}
    pairs = q["smp04_verification_pairs_default"](spark, at).collect()
    assert len(pairs) == len({(r.id_a, r.id_b) for r in pairs}) == 4000 and sum(r.label for r in pairs) == 2000
    assert all(r.id_a < r.id_b and (source[r.id_a] == source[r.id_b]) == bool(r.label) for r in pairs)
    # no draw is confined to a cell or a neighbourhood: all pairs of speakers come up
    assert len({frozenset((source[r.id_a], source[r.id_b])) for r in pairs if not r.label}) > min(200, len(set(source.values())) * (len(set(source.values())) - 1) // 4)
    sizes = {s: sum(x == s for x in source.values()) for s in set(source.values())}
    for r in q["smp08_rerank_sets_default"](spark, at).collect():
        # positives among the draws aside, the speaker gives each query 100 rows or all it has
        assert r.n_negative + r.n_positive >= min(100, sizes[source[r.qid]] - 1)
    assert q["smp02_capped_default"](spark, at).groupBy("speaker_id").count().where("count > 10").count()
    assert q["smp01_subset_default"](spark, at).where("grouped").count() >= q["smp01_subset"](spark, at).where("grouped").count()


def test_p_of_rank_correlations(spark):
    rows = spark.createDataFrame([(0.5, 3), (0.5, 10), (-0.9, 5), (1.0, 6), (0.0, 7), (None, 7)], "rho double, n long")
    got = [r.p for r in rows.select(stats.spearman_p(F.col("rho"), F.col("n")).alias("p")).collect()]
    assert got[:3] == pytest.approx([2 / 3, 0.14111328, 0.03738607], abs=1e-7)
    assert got[3:5] == pytest.approx([0.0, 1.0]) and got[5] is None


def test_next_other_is_the_next_in_the_ring(spark):
    rows = [(i, i % 3, "ab"[i % 7 > 3] if i % 3 else "a") for i in range(40)]
    got = {r.id: r.other for r in sampling.next_other(spark.createDataFrame(rows, "id int, g int, v string"), "g", "v", "id", "s").collect()}
    order = [r.id for r in spark.range(40).select(F.col("id").cast("int").alias("id")).orderBy(keyed(13, "s", "id"), "id").collect()]
    value = {i: (g, v) for i, g, v in rows}
    for i in range(40):
        at = order.index(i)
        ring = [j for j in order[at + 1 :] + order[:at] if value[j][0] == value[i][0] and value[j][1] != value[i][1]]
        assert got[i] == (ring[0] if ring else None)


def test_content_pairs_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id int, k string, s int")
    assert sampling.content_pairs(empty, "k", "s", "id", 10).count() == 0
