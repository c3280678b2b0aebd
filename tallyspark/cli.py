"""Running tasks of a registry from the command line (API04)."""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .registry import Registry, run

CACHE = "TALLYSPARK_CACHE"


def options(argv: Sequence[str] | None = None) -> argparse.Namespace:
    """model, tasks or categories (not both; lists, or None for the default tasks), cache, results, raise_error.

    The cache is the folder given, else the one that the environment names, else one in the home folder.
    """
    p = argparse.ArgumentParser(prog="tallyspark", description="Score a model's embeddings on tasks.")
    p.add_argument("--model", required=True)
    which = p.add_mutually_exclusive_group()
    which.add_argument("--tasks", nargs="+", metavar="NAME")
    which.add_argument("--categories", nargs="+", metavar="NAME")
    p.add_argument("--embeddings", required=True, help="Parquet of the model's embeddings")
    p.add_argument("--cache")
    p.add_argument("--results", help="folder of results; by default in the cache")
    p.add_argument("--raise-error", action="store_true")
    found = p.parse_args(argv)
    found.cache = str(Path(found.cache or os.environ.get(CACHE) or "~/.cache/tallyspark").expanduser())
    found.results = found.results or f"{found.cache}/results"
    return found


def main(spark: SparkSession, registry: Registry, argv: Sequence[str] | None = None, read: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """Runs what ``argv`` asks for, adds the rows to the results and returns them. Tasks that the results have as done are kept."""
    o = options(argv)
    tasks = registry.select(o.tasks, o.categories)
    embeddings = read(spark, o.embeddings) if read else spark.read.parquet(o.embeddings)
    path = spark._jvm.org.apache.hadoop.fs.Path(o.results)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    rows = run(spark, o.model, embeddings, tasks, spark.read.parquet(o.results) if there else None, o.raise_error)
    rows.where("status <> 'kept'").write.mode("append").parquet(o.results)
    return rows
