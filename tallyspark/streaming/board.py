"""A leaderboard that follows its scores: keyed state in place of reading all cells again (ORC02-03).

A task's models are dealt into ``PARTS`` parts. A part's state is one value: its models, their scores and when these were made. A later score
takes the place of the earlier one, whatever order they arrive in, and an earlier one that comes late changes nothing. Only
parts that a batch brings something new for are written again; their cells replace the part's folder, so a batch that is run
again after a loss writes the same. The board ranks the cells that stand in the folders: a row for each model and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..session import written

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CELLS = "task string, model string, score double, folder string"
#: Parts of a task's models, and rows of a part that are sorted at a time.
PARTS, ROWS = 64, 100_000


def _latest(rows: list[pd.DataFrame]) -> pd.DataFrame:
    """Of each model the row that was made last, of equal times the one with the higher score."""
    return pd.concat(rows).sort_values(["at", "score"]).drop_duplicates("model", keep="last")


class Cells(StatefulProcessor):
    """Keeps the scores of a part of a task's models, read and written as one value, and gives all of them whenever one has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getValueState("cells", "model array<string>, at array<long>, score array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = pd.DataFrame(dict(zip(("model", "at", "score"), self.cells.get(), strict=True))) if self.cells.exists() else None
        new, n = [], 0
        for part in rows:
            new.append(part[["model", "at", "score"]])
            n += len(part)
            if n > ROWS:
                new = [_latest(new)]
                n = len(new[0]) // 2  # sorted again only when as many have come
        found = _latest(new if held is None else [held, *new]).sort_values("model")
        if held is not None and held["model"].tolist() == found["model"].tolist() and held["at"].tolist() == found["at"].tolist() and held["score"].tolist() == found["score"].tolist():
            return
        self.cells.update(tuple(found[c].tolist() for c in ("model", "at", "score")))
        yield pd.DataFrame({"task": key[0], "model": found["model"], "score": found["score"], "folder": f"{key[1]} {key[0]}"})

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Map states need this store; it has to be set when the query starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def follow(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """rows: a stream of model, task, score and at (whole numbers; the largest counts). Rows with a null in any of them are left out. Ends when what is there is done; started again it goes on."""
    spark = rows.sparkSession
    cells = rows.select(F.col("task").cast("string").alias("task"), F.col("model").cast("string").alias("model"), F.col("score").cast("double").alias("score"), F.col("at").cast("long").alias("at")).dropna()
    cells = cells.withColumn("part", F.pmod(F.xxhash64("model"), F.lit(PARTS)))

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(table)

    with _rocks(spark):
        stand = cells.groupBy("task", "part").transformWithStateInPandas(statefulProcessor=Cells(), outputStructType=CELLS, outputMode="Update", timeMode="None")
        return stand.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def placed(rows: DataFrame, group: str, by: str) -> DataFrame:
    """group, by, k and above: of each different value in a group how many rows have it and how many a higher one.

    Values are cut into ranges, so that no task takes a whole group.
    """
    n = rows.groupBy(group, by).agg(F.count("*").alias("k"))
    n = written(n.repartitionByRange(group, F.desc(by)).withColumn("slot", F.spark_partition_id()))
    each = n.groupBy(group, "slot").agg(F.sum("k").alias("s"))
    before = each.select(group, "slot", (F.sum("s").over(Window.partitionBy(group).orderBy("slot")) - F.col("s")).alias("before"))
    above = F.sum("k").over(Window.partitionBy(group, "slot").orderBy(F.desc(by))) - F.col("k")
    return n.join(before, [group, "slot"]).select(group, by, "k", (F.col("before") + above).alias("above"))


def board(spark: SparkSession, table: str) -> DataFrame:
    """model, n_tasks, points (in each task the number of all models less its rank) and rank, from the cells that stand; tied scores share the mean of their ranks."""
    cells = spark.read.schema(CELLS).parquet(table).drop("folder")
    n = cells.agg(F.countDistinct("model").alias("n"))
    ranks = placed(cells, "task", "score").select("task", "score", (F.col("above") + (F.col("k") + 1) / 2).alias("r"))
    points = cells.join(ranks, ["task", "score"]).crossJoin(F.broadcast(n)).groupBy("model").agg(F.count("*").alias("n_tasks"), F.sum(F.col("n") - F.col("r")).alias("points"))
    points = written(points).withColumn("all", F.lit(0))
    return points.join(placed(points, "all", "points"), ["all", "points"]).select("model", "n_tasks", "points", (F.col("above") + 1).cast("long").alias("rank"))
