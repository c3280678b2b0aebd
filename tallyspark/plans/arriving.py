"""Scores that arrive as a stream of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, table
from ..streaming import board
from .base import query


@query("""WITH k AS (SELECT user_id AS model, event_type AS task, arg_max(value, event_id) AS s FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL AND event_id IS NOT NULL GROUP BY 1, 2), n AS (SELECT count(DISTINCT model)::DOUBLE AS n FROM k),
r AS (SELECT model, task, rank() OVER (PARTITION BY task ORDER BY s DESC) + (count(*) OVER (PARTITION BY task, s) - 1) / 2.0::DOUBLE AS r FROM k) SELECT model::VARCHAR AS model, count(*) AS n_tasks, sum(n - r) AS points, rank() OVER (ORDER BY sum(n - r) DESC)::BIGINT AS rank FROM r, n GROUP BY 1""")
def orc03_following_board(spark: SparkSession, d: str) -> DataFrame:
    """A leaderboard kept up to date by keyed state while results arrive, corrections included: the same as one rebuilt from all of them (ORC02, ORC03)."""
    at = f"{d}/events.parquet"
    rows = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 1000).parquet(f"{at}*")
    rows = rows.select(F.col("user_id").alias("model"), F.col("event_type").alias("task"), F.col("value").alias("score"), F.col("event_id").alias("at"))
    to = shared_folder(spark)
    board.follow(rows, f"{to}/ranks", f"{to}/state").awaitTermination()
    return board.board(spark, f"{to}/ranks")
