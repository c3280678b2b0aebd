"""Letters are counted in one pass over a text, and only blanks that change are matched."""

from __future__ import annotations

import re

from tallyspark.operators.sampling import normal_text
from tallyspark.plans import matching


def test_counts_by_eighths_and_plans_without_a_pass_for_each_letter(spark):
    texts = ["", "a", "abcp \U0001f600 é zzz ponm", "abcdefghijklmnopq" * 7, "aa\U0001f600" * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "utt_id long, norm string")
    for r in matching.layered(rows).collect():
        t, n = texts[r.utt_id], len(texts[r.utt_id])
        parts = [t[n * k // 8 : n * (k + 1) // 8] for k in range(8)] + [t]
        assert r.counts == [[float(p.count(c)) for c in matching.LETTERS] for p in parts]
    assert "replace(" not in matching.layered(rows)._jdf.queryExecution().toString().lower()


def test_normal_text_is_as_with_every_run_replaced(spark):
    texts = [None, "", " ", "a b", "a  b", "\ta\nb \n c\x0b\x0cd\r", " a b ", "a b", "a \tb\r\n\r\nc d"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.norm for r in rows.select("i", normal_text(rows["t"]).alias("norm")).collect()}
    assert got == {i: re.sub(r"[ \t\n\x0b\f\r]+", " ", t or "").strip(" ") for i, t in enumerate(texts)}
