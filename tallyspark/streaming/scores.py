"""Scores that arrive as files: each cell once, and the analysis anew after each batch (ORC02-03)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.results import SCHEMA, entries

CELL = ("model", "revision", "task", "split", "entry")


def arriving(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The stream of entries of result documents under ``path``; a file is read once, when it appears, and rows without a score are left out."""
    raw = spark.readStream.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).json(path)
    return entries(raw.selectExpr("*", "_metadata.file_path AS path")).where("score IS NOT NULL")


def refreshed(rows: DataFrame, table: str, checkpoint: str, analysis: Callable[[DataFrame], None]) -> StreamingQuery:
    """Writes each batch to its own folder under ``table`` and runs ``analysis`` over all cells so far; ends when what is there is done.

    A batch that is run again after a loss replaces its own folder, so no cell is there twice by that;
    of cells that arrive in several batches the latest counts.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(list(CELL)).write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={number}")
        analysis(latest(batch.sparkSession, table))

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """One row for each cell under ``table``: that of its last batch."""
    from ..operators.ranking import best_rows

    every = spark.read.parquet(table)
    return best_rows(every, list(CELL), every["batch"].desc()).drop("batch")
