"""A session for tests and benchmarks, and the tables of a folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyspark")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepared(spark)


#: Rows of an Arrow batch: long texts stand in them, and a batch is in memory twice.
BATCH_ROWS = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """Python workers find this package wherever the driver was started, and get batches of bounded size unless the session sets its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.environ["PYTHONPATH"])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder's address under spark.checkpoint.dir; under a temporary folder only where none is set and all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tallyspark-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/tallyspark-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """The same rows, from files in the shared folder: read as often as they are used, made once."""
    at = shared_folder(rows.sparkSession)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
