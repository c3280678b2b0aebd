"""Result documents (SRC10-15): nested JSON with scores by split, model and revision in the path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "struct<main_score:double,hf_subset:string,v_measure:double,v_measure_std:double,ami:double,scores_per_experiment:array<struct<accuracy:double>>>"
SCHEMA = f"task_name string, mteb_version string, evaluation_time double, scores map<string,array<{ENTRY}>>"
SPLITS = ("test", "validation", "train")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A row for each entry of each split of each document under ``path``; files of model metadata, unreadable ones and those without scores are left out."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return entries(raw.select("*", F.col("_metadata.file_path").alias("path")))


def entries(docs: DataFrame) -> DataFrame:
    """docs: SCHEMA and path. Adds model, revision, split, subset, entry (place in its split) and the entry's scores."""
    parts = F.split("path", "/")
    good = docs.where(~F.element_at(parts, -1).startswith("model_meta") & F.col("task_name").isNotNull() & F.col("scores").isNotNull())
    rows = good.select("path", F.col("task_name").alias("task"), "mteb_version", "evaluation_time", F.replace(F.element_at(parts, -3), F.lit("__"), F.lit("/")).alias("model"), F.element_at(parts, -2).alias("revision"), F.explode("scores").alias("split", "list"))
    rows = rows.select("*", F.posexplode("list").alias("entry", "e")).drop("list")
    spread = F.aggregate("e.scores_per_experiment", F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x["accuracy"]).alias("s"), (a["q"] + x["accuracy"] * x["accuracy"]).alias("q")))
    rows = rows.withColumn("x", spread)
    std = F.when(F.col("x.n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("x.q") - F.col("x.s") * F.col("x.s") / F.col("x.n")) / (F.col("x.n") - 1))))
    return rows.select("path", "model", "revision", "task", "split", F.col("entry").cast("long").alias("entry"), F.col("e.hf_subset").alias("subset"), F.col("e.main_score").alias("score"), F.col("e.ami").alias("ami"), F.coalesce("e.v_measure_std", std).alias("dispersion"), "evaluation_time")


def by_policy(rows: DataFrame, policy: str) -> DataFrame:
    """One score a document ("first", "mean") or all of them ("all").

    first: the first entry of the first split by name; mean: over entries of the first of test,
    validation and train that is there, times 100.
    """
    if policy == "all":
        return rows.select("model", "task", "split", "entry", "score")
    if policy == "first":
        r = F.row_number().over(Window.partitionBy("path").orderBy("split", "entry"))
        return rows.withColumn("r", r).where("r = 1").select("model", "task", "score")
    if policy == "mean":
        place = F.coalesce(*[F.when(F.col("split") == s, F.lit(i)) for i, s in enumerate(SPLITS)])
        best = rows.withColumn("p", place).where("p IS NOT NULL").withColumn("b", F.min("p").over(Window.partitionBy("path"))).where("p = b")
        return best.groupBy("path", "model", "task").agg((F.avg("score") * 100).alias("score")).select("model", "task", "score")
    raise ValueError(f"no policy {policy}")
