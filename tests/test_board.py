"""The leaderboard that follows its scores against one made of all of them."""

import random

import pytest
from tallyspark.operators import ranking
from tallyspark.streaming import board

SCHEMA = "model string, task string, score double, at long"


def batch_board(spark, rows):
    last = {}
    for m, t, s, at in rows:
        if None not in (m, t, s, at) and (at, s) > last.get((m, t), (-1, 0)):
            last[m, t] = (at, s)
    cells = spark.createDataFrame([(m, t, s) for (m, t), (_, s) in last.items()], "model string, task string, score double")
    return {r.model: (round(r.points, 9), r.rank) for r in ranking.borda(cells).collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_same_as_a_batch_run_after_any_order_of_files(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"m{rng.randrange(6)}", f"t{rng.randrange(3)}", rng.randrange(5) / 4, at) for at in range(60)] + [(None, "t0", 1.0, 99), ("m1", "t1", None, 99)]
    rng.shuffle(rows)  # earlier results arrive after later ones
    at, done = tmp_path / "in", []
    for part in range(3):
        done += rows[part::3]
        spark.createDataFrame(rows[part::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(at))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(at))
        board.follow(stream, str(tmp_path / "ranks"), str(tmp_path / "state")).awaitTermination()
        got = {r.model: (round(r.points, 9), r.rank) for r in board.board(spark, str(tmp_path / "ranks")).collect()}
        assert got == batch_board(spark, done)


def test_a_tasks_models_are_dealt_into_parts_that_are_kept_as_one_value_each(spark, tmp_path):
    rows = [(f"m{i % 900}", "t/0", float(i % 7), i) for i in range(1800)]
    at, ranks = str(tmp_path / "in"), str(tmp_path / "ranks")
    for batch in (rows, [("m5", "t/0", 99.0, 5000), ("m6", "t/0", -1.0, 1)]):  # then one newer score and one that comes late
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(at)
        before = {p: p.stat().st_mtime_ns for p in (tmp_path / "ranks").glob("*/*.parquet")}
        board.follow(spark.readStream.schema(SCHEMA).parquet(at), ranks, str(tmp_path / "state")).awaitTermination()
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "ranks").glob("*/*.parquet")}
    assert 32 < len(before) <= board.PARTS  # a state for each part, not for each task
    assert len(before.items() - after.items()) == 1  # only the part of m5 is written again
    got = {r.model: (r.points, r.rank) for r in board.board(spark, ranks).collect()}
    assert got == batch_board(spark, [*rows, ("m5", "t/0", 99.0, 5000)])
    assert got["m5"][1] == 1


def test_values_are_placed_across_ranges(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randrange(2)}", float(rng.randrange(40))) for _ in range(500)] + [("", 1.0), ("", 1.0), ("", 2.0)]
    got = {(r.g, r.v): (r.k, r.above) for r in board.placed(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got == {(g, v): (rows.count((g, v)), sum(h == g and w > v for h, w in rows)) for g, v in set(rows)}
