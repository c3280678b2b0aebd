"""Exact word counts by levels of blocks."""

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import ppm


def _docs(spark, n):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 40) % 500) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_levels_give_the_same_counts_and_rows_grow_with_the_blocks(spark, monkeypatch):
    docs = _docs(spark, 400)
    columns = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score")
    flat = sorted(ppm.score(docs, F.col("doc_id") % 3 > 0).select(*columns).collect())
    monkeypatch.setattr(ppm, "FAN_IN", 4)
    rows = {}
    for size in (8000, 4000):
        monkeypatch.setattr(ppm, "BLOCK_BYTES", size)
        blocked, n = ppm._blocks(docs, "text", F.col("doc_id") % 3 > 0)
        rows[n] = ppm.counts(blocked, n).where("kind = 'word'").count()
    assert min(rows) > 4
    assert all(have <= 4 * n for n, have in rows.items())
    cut = sorted(ppm.score(docs, F.col("doc_id") % 3 > 0).select(*columns).collect())
    assert [r[:4] for r in cut] == [r[:4] for r in flat]
    assert np.allclose([r[4] for r in cut], [r[4] for r in flat])
