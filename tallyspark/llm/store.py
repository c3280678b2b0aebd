"""Tables cut from their lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, else the checkpoint folder set; a temporary one only where neither is set and all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tallyspark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def kept(rows: DataFrame) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read back, so that a lost executor costs nothing done before."""
    at = f"{folder(rows.sparkSession).rstrip('/')}/tallyspark-{uuid.uuid4().hex}"
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)
