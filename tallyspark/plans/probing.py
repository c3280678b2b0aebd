"""Probes and clusterings of layers over seeds: sweeps, chosen layers carried to the other half, solvers against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import keyed
from ..operators import agreement, minibatch, probes, structure, sweeps
from ..session import written
from .base import query, r6, vectors
from .layers import LAY, LAYERS, _layers

NAMES = tuple(f"l{k}" for k in range(LAYERS))
EVERY = (*NAMES, "uniform")
#: The sweep on the choosing half takes one split, scoring on the other half three.
SWEEP_SEEDS, SCORE_SEEDS, CLUSTER_SEEDS = (0,), (0, 1, 2), (0, 1, 2, 3, 4)
SWEEP_STARTS, SEED_STARTS = 3, 5


def _dev() -> object:
    return keyed(9, "half", "id") % 2 == 0


def _halved(spark: SparkSession, d: str, seeds: Sequence[int]) -> DataFrame:
    rows = probes.splits(_layers(spark, d).withColumn("dev", _dev()), "label", "id", seeds, within=["dev"])
    for s in seeds:
        for side, here in (("dev", F.col("dev")), ("held", ~F.col("dev"))):
            rows = rows.withColumns({f"{side}_{kind}_{s}": F.col(f"{kind}_{s}") & here for kind in ("train", "test")})
    return rows


def layer_sweep(spark: SparkSession, d: str) -> DataFrame:
    """half (dev, held), layer (-1: mean of layers), seed and the scores of a probe of each: all fitted in the same passes."""
    rows = _halved(spark, d, SCORE_SEEDS)
    jobs = [(half, k, s) for half, seeds in (("dev", SWEEP_SEEDS), ("held", SCORE_SEEDS)) for k in range(-1, LAYERS) for s in seeds]
    models = [sweeps.Model(f"{half} {k} {s}", NAMES[k] if k >= 0 else "uniform", f"{half}_train_{s}", f"{half}_test_{s}") for half, k, s in jobs]
    blocks = sweeps.packed(rows, EVERY, "label", sorted({f for m in models for f in (m.train, m.test)}))
    try:
        out = sweeps.scores(blocks, models, sweeps.fit(blocks, models))
    finally:
        blocks.close()
    part = lambda i: F.element_at(F.split("model", " "), i)
    return out.select(part(1).alias("half"), part(2).cast("int").alias("layer"), part(3).cast("int").alias("seed"), *[c for c in out.columns if c != "model"])


def _best(rows: DataFrame, score: str) -> int | None:
    """The layer of the best score, the lowest of equals; the mean of layers isn't one."""
    top = rows.where("layer >= 0").agg(F.max(F.struct(F.round(score, 9).alias("s"), F.negative("layer").alias("o"))).alias("x")).first().x
    return None if top is None else -top.o


def layer_clusterings(spark: SparkSession, d: str, seeds: Sequence[int], starts: int, dev: bool) -> DataFrame:
    """layer, seed and the agreement of a clustering into as many clusters as there are labels with these, on one half."""
    rows = written(_layers(spark, d).where(_dev() if dev else ~_dev()))
    k = rows.select("label").distinct().count()
    runs = minibatch.fit(rows, EVERY, k, seeds, starts)
    found = agreement.by_group(minibatch.counted(rows, runs, "label"), ["vec", "seed"], "label", "cluster", "n")
    layer = F.when(F.col("vec") == "uniform", -1).otherwise(F.substring("vec", 2, 9).try_cast("int"))
    return found.withColumn("layer", layer)


@query()
def prb01_shots(spark: SparkSession, d: str) -> DataFrame:
    """Probe on eight rows of each label, ten times, all in the same passes (PRB01)."""
    rows = vectors(spark, d)
    for s in range(10):
        rows = probes.shots(rows, "label", "id", s).withColumnRenamed("test", f"test_{s}").withColumn(f"train_{s}", ~F.col(f"test_{s}"))
    models = [sweeps.Model(str(s), "vec", f"train_{s}", f"test_{s}") for s in range(10)]
    return _fitted(rows, models).withColumn("repeat", F.col("model").cast("int")).drop("model")


@query()
def prb03_probe(spark: SparkSession, d: str) -> DataFrame:
    """Linear probe over three stratified splits, with two caps on steps (PRB02-06)."""
    rows = probes.splits(vectors(spark, d), "label", "id", SCORE_SEEDS)
    models = [sweeps.Model(f"{s} {cap}", "vec", f"train_{s}", f"test_{s}", cap) for s in SCORE_SEEDS for cap in (200, 2000)]
    part = lambda i: F.element_at(F.split("model", " "), i).cast("int")
    return _fitted(rows, models).withColumn("seed", part(1)).withColumn("steps", part(2)).drop("model")


def _fitted(rows: DataFrame, models: Sequence[sweeps.Model]) -> DataFrame:
    blocks = sweeps.packed(rows, ["vec"], "label", sorted({f for m in models for f in (m.train, m.test)}))
    try:
        return sweeps.scores(blocks, models, sweeps.fit(blocks, models))
    finally:
        blocks.close()


@query()
def prb07_solver_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Probes of three kinds of vectors by L-BFGS and by Newton's method: accuracies, losses, predictions and probabilities against each other (PRB07)."""
    rows = probes.splits(_layers(spark, d).join(vectors(spark, d).select("id", "vec"), "id"), "label", "id", (0,))
    models = [sweeps.Model(v, v, "train_0", "test_0", 1000) for v in ("l0", NAMES[-1], "vec")]
    blocks = sweeps.packed(rows, ["l0", NAMES[-1], "vec"], "label", ["train_0", "test_0"])
    try:
        one, two = (sweeps.fit(blocks, models, solver, tolerance=1e-9) for solver in ("lbfgs", "newton"))
        gaps = sweeps.agreement(blocks, models, one, two)
        a, b = (sweeps.scores(blocks, models, x).select("model", F.col("accuracy").alias(f"accuracy_{n}"), F.col("train_loss").alias(f"loss_{n}"), F.col("iterations").alias(f"iterations_{n}"), "n_train") for x, n in ((one, "lbfgs"), (two, "newton")))
    finally:
        blocks.close()
    out = gaps.join(a, "model").join(b.drop("n_train"), "model")
    near = F.round(F.col("loss_lbfgs") - F.col("loss_newton"), 9)
    return out.select("model", F.lit(len(blocks.classes)).alias("n_classes"), "n_train", "n_test", "accuracy_lbfgs", "accuracy_newton", (F.col("accuracy_lbfgs") - F.col("accuracy_newton")).alias("accuracy_gap"), r6("loss_lbfgs").alias("loss_lbfgs"), r6("loss_newton").alias("loss_newton"), near.alias("loss_gap"), "same", r6("max_gap").alias("max_gap"), r6("mean_gap").alias("mean_gap"))


@query()
def prb04_layer_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A probe of each layer and split, on the half that layers are chosen on and on the other (PRB04, PRB05)."""
    out = layer_sweep(spark, d)
    return out.select("half", "layer", "seed", "n_train", "n_test", *[r6(c).alias(c) for c in ("accuracy", "train_loss", "test_loss", "loss_before", "loss_after")], "iterations", "capped", (F.col("gradient") < 1e-5).alias("converged"))


@query()
def prb08_reproduced(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the sweep, as stored to three places, held against probes fitted anew by the other solver, within a percent (PRB08)."""
    stored = layer_sweep(spark, d).where("half = 'held'").select("layer", "seed", F.round("accuracy", 3).alias("reported"))
    rows = _halved(spark, d, SCORE_SEEDS)
    models = [sweeps.Model(f"{k} {s}", NAMES[k] if k >= 0 else "uniform", f"held_train_{s}", f"held_test_{s}") for k in range(-1, LAYERS) for s in SCORE_SEEDS]
    blocks = sweeps.packed(rows, EVERY, "label", sorted({f for m in models for f in (m.train, m.test)}))
    try:
        again = sweeps.scores(blocks, models, sweeps.fit(blocks, models, "newton"))
    finally:
        blocks.close()
    part = lambda i: F.element_at(F.split("model", " "), i).cast("int")
    gap = F.abs(F.col("refitted") - F.col("reported"))
    return stored.join(again.select(part(1).alias("layer"), part(2).alias("seed"), F.col("accuracy").alias("refitted")), ["layer", "seed"]).select("layer", "seed", "reported", r6("refitted").alias("refitted"), r6(gap).alias("diff"), (gap <= 0.01).alias("reproduced"))


@query()
def qry33_classification_transfer(spark: SparkSession, d: str) -> DataFrame:
    """The layer that a probe is best on in one half, scored on the other: against the final layer, the mean of layers and the layer that clusterings choose (QRY33)."""
    sweep = layer_sweep(spark, d)
    picked = _best(sweep.where("half = 'dev'"), "accuracy")
    clustered = _best(layer_clusterings(spark, d, SWEEP_SEEDS, SWEEP_STARTS, True), "ami")
    held = sweep.where("half = 'held'").groupBy("layer").agg(F.avg("accuracy").alias("m"), F.stddev_pop("accuracy").alias("sd"), F.max(F.col("n_train") + F.col("n_test")).alias("n"))
    at = lambda k, c="m": F.max(F.when(F.col("layer") == F.lit(k), F.col(c)))
    k = _layers(spark, d).where(~_dev()).select("label").distinct().count()
    row = held.agg(F.max("n").alias("n"), at(picked).alias("selected"), at(picked, "sd").alias("selected_sd"), at(LAYERS - 1).alias("final"), at(-1).alias("uniform"), at(clustered).alias("clustering_layer"))
    gap = lambda x, y: r6(F.col(x) - F.col(y))
    return row.select(
        F.lit(picked).cast("int").alias("picked_layer"), F.lit(clustered).cast("int").alias("clustering_picked_layer"), F.lit(LAYERS - 1).alias("final_layer"), "n", F.lit(k).alias("n_classes"),
        *[r6(c).alias(c) for c in ("selected", "selected_sd", "final", "uniform", "clustering_layer")],
        gap("selected", "final").alias("gain_vs_final"), gap("selected", "uniform").alias("gain_vs_uniform"), gap("selected", "clustering_layer").alias("cost_of_clustering_layer"),
    )


@query()
def clu12_kmeans_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Clusterings of the vectors into as many clusters as labels, by seed, and their means and deviations (CLU01, CLU12)."""
    rows = vectors(spark, d)
    k = rows.select("label").distinct().count()
    each = agreement.by_group(minibatch.counted(rows, minibatch.fit(rows, ["vec"], k, CLUSTER_SEEDS, SEED_STARTS), "label"), ["seed"], "label", "cluster", "n")
    names = ("v_measure", "ari", "ami", "purity")
    whole = each.agg(F.count("*").alias("n_seeds"), *[f(n).alias(f"{n}_{s}") for n in names for s, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    return each.crossJoin(F.broadcast(whole)).select("seed", F.lit(k).alias("n_clusters"), "n_seeds", *[r6(c).alias(c) for n in names for c in (n, f"{n}_mean", f"{n}_sd")])


STRUCTURE = LAY + """, x AS (SELECT layer, id, label, unnest(vec) AS v, generate_subscripts(vec, 1) AS p FROM lay WHERE layer >= 0), n AS (SELECT layer, label, count(*)::DOUBLE AS n FROM lay WHERE layer >= 0 GROUP BY 1, 2),
c AS (SELECT layer, label, p, avg(v) AS c FROM x GROUP BY 1, 2, 3), mu AS (SELECT layer, p, avg(v) AS m FROM x GROUP BY 1, 2),
b AS (SELECT layer, sum(n * (c - m) * (c - m)) AS b FROM c JOIN mu USING (layer, p) JOIN n USING (layer, label) GROUP BY 1), w AS (SELECT layer, sum((v - c) * (v - c)) AS w FROM x JOIN c USING (layer, label, p) GROUP BY 1),
q AS (SELECT layer, label, avg(far) AS s FROM (SELECT layer, id, label, sqrt(sum((v - c) * (v - c))) AS far FROM x JOIN c USING (layer, label, p) GROUP BY 1, 2, 3) GROUP BY 1, 2),
apart AS (SELECT a.layer, a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m FROM c a JOIN c b ON a.layer = b.layer AND a.p = b.p AND a.label <> b.label GROUP BY 1, 2, 3),
worst AS (SELECT layer, avg(x) AS dbi FROM (SELECT m.layer, i, max((a.s + b.s) / m.m) AS x FROM apart m JOIN q a ON a.layer = m.layer AND a.label = i JOIN q b ON b.layer = m.layer AND b.label = j GROUP BY 1, 2) GROUP BY 1),
duo AS (SELECT a.layer, a.id, a.label AS la, b.label AS lb, a.id % 25 AS ga, b.id % 25 AS gb, a.id < b.id AS up, list_inner_product(a.vec, b.vec) AS sim FROM lay a JOIN lay b ON a.layer = b.layer AND a.id <> b.id WHERE a.layer >= 0),
mc AS (SELECT layer, avg(sim) FILTER (WHERE up) AS mean_cos FROM duo GROUP BY 1),
far AS (SELECT layer, id, la, lb, avg(1 - sim) AS d FROM duo GROUP BY 1, 2, 3, 4), near AS (SELECT layer, id, max(d) FILTER (WHERE la = lb) AS a, min(d) FILTER (WHERE la <> lb) AS b FROM far GROUP BY 1, 2),
sl AS (SELECT layer, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS sil FROM near GROUP BY 1),
farg AS (SELECT layer, id, ga, gb, avg(1 - sim) AS d FROM duo GROUP BY 1, 2, 3, 4), nearg AS (SELECT layer, id, max(d) FILTER (WHERE ga = gb) AS a, min(d) FILTER (WHERE ga <> gb) AS b FROM farg GROUP BY 1, 2),
sg AS (SELECT layer, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS sil FROM nearg GROUP BY 1),
cov AS (SELECT layer, p, q, sum(s) AS s FROM (SELECT a.layer, a.p, b.p AS q, (a.v - ma.m) * (b.v - mb.m) AS s FROM x a JOIN x b ON a.layer = b.layer AND a.id = b.id JOIN mu ma ON ma.layer = a.layer AND ma.p = a.p JOIN mu mb ON mb.layer = b.layer AND mb.p = b.p) GROUP BY 1, 2, 3),
er AS (SELECT layer, pow(sum(s) FILTER (WHERE p = q), 2) / sum(s * s) AS eff FROM cov GROUP BY 1), k AS (SELECT layer, count(*) AS n_labels, sum(n) AS n_rows FROM n GROUP BY 1)
SELECT layer::INT AS layer, n_labels, n_rows::BIGINT AS n_rows, round(mean_cos, 6) AS mean_cos, round(eff, 6) AS eff_rank, round(sl.sil, 6) AS sil_label, round(dbi, 6) AS dbi, round(b / (n_labels - 1) / (w / (n_rows - n_labels)), 6) AS chi, round(sg.sil, 6) AS cnt_sil
FROM k JOIN mc USING (layer) JOIN er USING (layer) JOIN sl USING (layer) JOIN sg USING (layer) JOIN worst USING (layer) JOIN b USING (layer) JOIN w USING (layer)"""


@query(STRUCTURE)
def qry28_label_structure(spark: SparkSession, d: str, groups: int = 25) -> DataFrame:
    """How labels and content groups (ids modulo ``groups``) lie in each layer's vectors: the part of the cluster table that needs no clustering (QRY28)."""
    x = structure.long(_layers(spark, d), NAMES, "id", "label")
    out = structure.spreads(x).join(structure.shapes(x), "layer").join(structure.silhouettes(x), "layer")
    content = structure.silhouettes(x.withColumn("label", F.pmod("id", F.lit(groups)))).withColumnRenamed("silhouette", "cnt_sil")
    row = out.join(content, "layer")
    return row.select(F.substring("layer", 2, 9).cast("int").alias("layer"), "n_labels", "n_rows", r6("mean_cos").alias("mean_cos"), r6("eff_rank").alias("eff_rank"), r6("silhouette").alias("sil_label"), r6("davies_bouldin").alias("dbi"), r6("calinski_harabasz").alias("chi"), r6("cnt_sil").alias("cnt_sil"))


@query()
def qry28_cluster_table(spark: SparkSession, d: str) -> DataFrame:
    """The cluster table: for each layer a clustering into as many clusters as labels, its silhouette and agreement with the labels, beside the labels' own structure (QRY28)."""
    rows = _layers(spark, d)
    k = rows.select("label").distinct().count()
    found = minibatch.labelled(rows, minibatch.fit(rows, NAMES, k, (0,), SWEEP_STARTS), "id", "label")
    agreed = agreement.by_group(found, ["vec"], "label", "cluster").select(F.col("vec").alias("layer"), "nmi", "ari", "purity")
    own = structure.long(rows, NAMES, "id").join(found.select(F.col("vec").alias("layer"), "id", F.col("cluster").alias("label")), ["layer", "id"])
    out = agreed.join(structure.silhouettes(own), "layer").select(F.substring("layer", 2, 9).cast("int").alias("layer"), F.lit(k).alias("k_clusters"), r6("silhouette").alias("sil_km"), r6("ari").alias("ari"), r6("nmi").alias("nmi"), r6("purity").alias("purity"))
    return out.join(qry28_label_structure(spark, d), "layer")


@query()
def qry32_seed_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each seed's agreement of clusterings with the labels on the held half: of the layer chosen on the other half, the final one, the mean of layers and the best here (QRY32)."""
    return _seeded(spark, d)[0]


@query()
def qry32_seed_gains(spark: SparkSession, d: str) -> DataFrame:
    """Means over seeds of the same, and what the chosen layer gains (QRY32)."""
    each, picked, best = _seeded(spark, d)
    m = each.groupBy("condition").agg(F.avg("ami").alias("m"), F.stddev_pop("ami").alias("sd"), F.count("*").alias("n_seeds"))
    of = lambda c, x="m": F.max(F.when(F.col("condition") == c, F.col(x)))
    row = m.agg(F.max("n_seeds").alias("n_seeds"), *[of(c, x).alias(f"{c}_{y}") for c in ("selected", "final", "uniform", "best_test") for x, y in (("m", "mean"), ("sd", "sd"))])
    gap = lambda a, b: r6(F.col(f"{a}_mean") - F.col(f"{b}_mean"))
    return row.select(
        F.lit(picked).cast("int").alias("picked_layer"), F.lit(LAYERS - 1).alias("final_layer"), F.lit(best).cast("int").alias("best_test_layer"), "n_seeds",
        *[r6(c).alias(c) for c in row.columns if c != "n_seeds"],
        gap("selected", "final").alias("gain_vs_final"), gap("selected", "uniform").alias("gain_vs_uniform"), gap("best_test", "selected").alias("shortfall"),
    )


def _seeded(spark: SparkSession, d: str) -> tuple[DataFrame, int | None, int | None]:
    """condition, seed, ami; the layer chosen on one half and the one that is best on the other, both by their mean over the same seeds."""
    mean = lambda rows: rows.groupBy("layer").agg(F.avg("ami").alias("ami"))
    picked = _best(mean(layer_clusterings(spark, d, CLUSTER_SEEDS, SEED_STARTS, True)), "ami")
    held = layer_clusterings(spark, d, CLUSTER_SEEDS, SEED_STARTS, False).select("layer", "seed", "ami")
    held = spark.createDataFrame(held.collect(), held.schema)  # a row for each layer and seed
    best = _best(mean(held), "ami")
    kinds = spark.createDataFrame([("selected", picked), ("final", LAYERS - 1), ("uniform", -1), ("best_test", best)], "condition string, layer int")
    return kinds.join(held, "layer").select("condition", "layer", "seed", r6("ami").alias("ami")), picked, best


@query()
def qry43_cluster_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The purity of clusterings over seeds, held against random partitions of as many parts and against the largest label (QRY43, CLU11)."""
    rows = vectors(spark, d)
    k = rows.select("label").distinct().count()
    found = minibatch.counted(rows, minibatch.fit(rows, ["vec"], k, CLUSTER_SEEDS, SWEEP_STARTS), "label")
    chance = rows.select("id", "label", F.explode(F.array(*map(F.lit, CLUSTER_SEEDS))).alias("seed")).select("seed", "label", (keyed(31, "cluster", "seed", "id") % max(k, 1)).alias("cluster"))
    mean = lambda x, n, w=None: agreement.by_group(x, ["seed"], "label", "cluster", w).agg(F.avg("purity").alias(n), F.avg("ami").alias(f"{n}_ami"))
    most = rows.groupBy("label").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("majority"))
    row = mean(found, "clustered", "n").crossJoin(mean(chance, "random")).crossJoin(most)
    verdict = F.when(F.col("clustered") > 2 * F.col("random"), "above chance").when(F.col("clustered") > F.col("random") + 0.05, "near chance").otherwise("chance")
    return row.select(*[r6(c).alias(c) for c in ("clustered", "clustered_ami", "random", "random_ami", "majority")], verdict.alias("verdict"))
