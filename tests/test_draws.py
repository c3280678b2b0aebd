"""Triplets and reranking sets are drawn among all fitting rows: each against a plain loop, null and short durations too."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def _keyed(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_triplets_are_drawn_among_all_near_rows(spark, tmp_path):
    rows = [(i, f"text {i // 2 if i < 60 else i}", f"s{i % 4 if i < 60 else 0}", [0, 1, 5, 40, 48, 49, 50, 60, 64, 300][i * 7 % 10] + i % 3) for i in range(160)]
    rows += [(900, "text 1", "s9", 10_000), (901, "alone", "s9", 3)]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows], "n_chars": [r[3] for r in rows], "lang": ["en"] * len(rows)}), tmp_path / "documents.parquet")
    want = {}
    for i, t, s, d in rows:
        pals = [x for x in rows if x[1] == t and x[2] != s]
        mates = [(int(max(d, x[3]) / max(min(d, x[3]), 1) > 1.25), _keyed(3, "speaker", i, x[0]), x[0]) for x in rows if x[2] == s and x[1] != t]
        if pals and mates:
            want[i] = (min((_keyed(3, "content", i, x[0]), x[0]) for x in pals)[1], min(mates)[2], min(mates)[0])
    got = {r.q: (r.content, r.speaker, r.dur_fallbacks) for r in entry.queries()["smp14_triplets"](spark, str(tmp_path)).collect()}
    assert got == want and {x[2] for x in want.values()} == {0, 1}


def test_each_query_draws_its_own_negatives(spark, tmp_path):
    rows = [(i, f"text {i // 2}", f"s{i % 2}") for i in range(1400)]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows], "n_chars": [9] * len(rows), "lang": ["en"] * len(rows)}), tmp_path / "documents.parquet")
    from tallyspark.plans.inference import SEED

    got = {r.qid: (r.n_positive, r.n_negative, r.did_sum) for r in entry.queries()["smp08_rerank_sets_default"](spark, str(tmp_path)).collect()}
    assert len(got) == 1400
    for q in (0, 1, 700, 1399):
        first = lambda salt, may: sorted((_keyed(SEED, salt, q, i), i) for i in may)[:100]  # noqa: E731, B023
        drawn = {i for _, i in first("hard", [i for i, _, s in rows if s == f"s{q % 2}" and i != q])} | {i for _, i in first("easy", range(1400))} - {q}
        pal = {q ^ 1}
        assert got[q] == (1, len(drawn - pal), sum(drawn | pal))
