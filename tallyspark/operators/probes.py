"""Clusterings and linear probes over vectors (CLU01, CLU12, PRB01-07), fitted by Spark's own learners."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import keyed
from . import agreement


def clustered(rows: DataFrame, k: int, seed: int, starts: int = 1, steps: int = 50) -> DataFrame:
    """Adds cluster: k-means on vec (array<double>); of ``starts`` runs the one of least cost."""
    data = rows.withColumn("__f", array_to_vector("vec"))
    runs = [KMeans(k=k, seed=seed * 1000 + i, maxIter=steps, featuresCol="__f", predictionCol="cluster").fit(data) for i in range(starts)]
    return min(runs, key=lambda m: m.summary.trainingCost).transform(data).drop("__f")


def cluster_scores(rows: DataFrame, label: str, seeds: Sequence[int], starts: int = 1) -> DataFrame:
    """seed, n_clusters, v_measure, ari, ami, purity of a clustering into as many clusters as there are labels."""
    k = rows.select(label).distinct().count()

    def one(seed: int) -> DataFrame:
        found = clustered(rows, k, seed, starts).select(label, "cluster")
        both = agreement.scores(found, label, "cluster").crossJoin(agreement.adjusted_mi(found, label, "cluster"))
        return both.select(F.lit(seed).alias("seed"), F.lit(k).alias("n_clusters"), "v_measure", "ari", "ami", "purity")

    return reduce(DataFrame.unionByName, [one(s) for s in seeds])


def halves(rows: DataFrame, label: str, ident: str, seed: int, share: float = 0.3) -> DataFrame:
    """Adds test: of each label's rows the first round(n * share) in keyed order, one at least; labels of one row are left out."""
    w = Window.partitionBy(label)
    n = F.count(F.lit(1)).over(w)
    placed = rows.withColumn("__n", n).withColumn("__r", F.row_number().over(w.orderBy(keyed(seed, "probe", ident), ident)))
    return placed.where("__n > 1").withColumn("test", F.col("__r") <= F.greatest(F.lit(1), F.bround(F.col("__n") * share))).drop("__n", "__r")


def shots(rows: DataFrame, label: str, ident: str, seed: int, n: int = 8) -> DataFrame:
    """Adds test: all but ``n`` rows of each label, these by keyed order."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(keyed(seed, "shots", ident), ident))
    return rows.withColumn("__r", place).withColumn("test", F.col("__r") > n).drop("__r")


def splits(rows: DataFrame, label: str, ident: str, seeds: Sequence[int], share: float = 0.3, within: Sequence[str] = ()) -> DataFrame:
    """Adds train_<seed> and test_<seed>: ``halves`` by each of ``seeds`` at once, inside each group of ``within``; rows of labels of one row are in neither."""
    w = Window.partitionBy(*within, label)
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(w))
    for s in seeds:
        first = F.row_number().over(w.orderBy(keyed(s, "probe", ident), ident)) <= F.greatest(F.lit(1), F.bround(F.col("__n") * share))
        rows = rows.withColumn(f"test_{s}", first & (F.col("__n") > 1)).withColumn(f"train_{s}", ~first & (F.col("__n") > 1))
    return rows.drop("__n")


def fit(rows: DataFrame, label: str, l2: float = 1.0, steps: int = 200) -> tuple[LogisticRegressionModel, DataFrame]:
    """A multinomial logistic model of the rows that aren't ``test``, and all rows with probability and prediction.

    Vectors are standardised with the training rows' moments. The loss is the mean log loss plus
    l2 / (2 n) times the squared weights; intercepts are free. Labels are numbers from 0.
    """
    data = rows.withColumn("__v", array_to_vector("vec"))
    train = data.where("NOT test")
    scaler = StandardScaler(inputCol="__v", outputCol="__f", withMean=True, withStd=True).fit(train)
    data = scaler.transform(data)
    learner = LogisticRegression(featuresCol="__f", labelCol=label, family="multinomial", maxIter=steps, regParam=l2 / max(train.count(), 1), standardization=False)
    model = learner.fit(data.where("NOT test"))
    return model, model.transform(data).drop("__v", "__f", "rawPrediction")


def probe_scores(rows: DataFrame, label: str, steps: int = 200, l2: float = 1.0) -> DataFrame:
    """steps, n_train, n_test, accuracy on test rows, iterations, capped, loss before and after: one row."""
    model, out = fit(rows, label, l2, steps)
    history = model.summary.objectiveHistory
    done = model.summary.totalIterations
    return out.agg(
        F.lit(steps).alias("steps"), F.count_if(~F.col("test")).alias("n_train"), F.count_if("test").alias("n_test"), F.avg(F.when(F.col("test"), (F.col("prediction") == F.col(label)).cast("double"))).alias("accuracy"),
        F.lit(done).alias("iterations"), F.lit(done >= steps).alias("capped"), F.lit(history[0]).alias("loss_before"), F.lit(history[-1]).alias("loss_after"),
    )


def solver_agreement(a: DataFrame, b: DataFrame, ident: str) -> DataFrame:
    """n_test, same (share of equal predictions), max_gap and mean_gap of probabilities, of two fits of the same rows."""
    from pyspark.ml.functions import vector_to_array

    pick = lambda x, s: x.where("test").select(ident, F.col("prediction").alias(f"p{s}"), vector_to_array("probability").alias(f"q{s}"))
    gaps = F.zip_with("qa", "qb", lambda x, y: F.abs(x - y))
    both = pick(a, "a").join(pick(b, "b"), ident).withColumn("g", gaps)
    mean = F.aggregate("g", F.lit(0.0), lambda s, x: s + x) / F.size("g")
    return both.agg(F.count("*").alias("n_test"), F.avg((F.col("pa") == F.col("pb")).cast("double")).alias("same"), F.max(F.array_max("g")).alias("max_gap"), F.avg(mean).alias("mean_gap"))
