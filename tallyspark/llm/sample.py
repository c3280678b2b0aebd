"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, train: object = None, text: str = "text") -> DataFrame:
    """``text`` and ``label`` of at most ``limit`` labelled documents, those of the lowest hash of doc_id.

    ``train`` is a condition on doc_id that rows must meet. The ids are chosen on the narrow label
    table, so the broadcast side has ``limit`` rows of two numbers at most. Rows with a null id or
    label are left out; of repeated label rows for an id the smallest label counts; every copy of a
    document that repeats an id is kept. Ids that aren't whole numbers are compared as text.
    """
    kind = "long" if isinstance(docs.schema["doc_id"].dataType, IntegralType) else "string"
    rows = labels.select(F.col("doc_id").try_cast(kind).alias("doc_id"), F.col(label).cast("int").alias(label)).dropna()
    if train is not None:
        rows = rows.where(train)
    ids = rows.groupBy("doc_id").agg(F.min(label).alias(label)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select(F.col("doc_id").cast(kind).alias("doc_id"), text).join(F.broadcast(ids), "doc_id")


def crc_of_id(n: int) -> object:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
