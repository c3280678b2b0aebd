"""Candidate rows of reranking queries and the corpus that they close over (SMP07, SMP08): no query meets all rows.

Rows are numbered in a keyed order, within their holder and over all. A query draws its negatives as a run of that order
that starts where its own key says and closes in a ring: in a random order any run is a random sample, and drawing it is a join on
numbers. Numbers come from counts of ranges of the key, so no holder's rows are ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import keyed, keyed_sql
from ..session import shared_folder

RANGES = 12


def numbered(rows: DataFrame, key: Column, ident: str, *within: str) -> DataFrame:
    """Adds place (from 0, by ``key`` and ``ident``) and size, in each group of ``within``. key: whole numbers below 2^32."""
    rows = rows.withColumn("__key", key).withColumn("__range", F.shiftright("__key", 32 - RANGES))
    counts = rows.groupBy(*within, "__range").agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*within, *([] if within else [F.lit(0)]))  # 2^RANGES rows a group at most
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("__n").over(group)).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*within, "__range").orderBy("__key", ident)) - 1
    return rows.withColumn("__at", inside).join(starts, [*within, "__range"]).withColumn("place", F.col("__start") + F.col("__at")).drop("__key", "__range", "__at", "__start")


def candidates(rows: DataFrame, kind: str, holder: str, ident: str, n_queries: int, n_hard: int, n_easy: int, seed: int, apart: bool) -> DataFrame:
    """qid, did, rel: for each query all rows of its ``kind`` by other holders (rel 1), ``n_hard`` of its holder and ``n_easy`` of any (rel 0).

    Queries are the first ``n_queries`` of a keyed order that have a row of rel 1. apart: rows of a query's holder must be of another kind.
    A row that is drawn twice counts once, as relevant if it is; queries without a row of rel 0 are left out. Null kinds and holders take no part.
    ident: whole numbers, unique. What a query draws, and the number of queries, are bounded; the rows of its kind aren't.
    """
    m = rows.select(F.col(ident).alias("did"), F.col(holder).alias("h"), F.col(kind).alias("k"))
    at = shared_folder(rows.sparkSession)
    m.dropna().write.parquet(at)  # narrow rows, which all that follows reads in place of texts
    known = rows.sparkSession.read.schema(m.schema).parquet(at)
    held = known.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("k")
    q = known.join(held, "k").orderBy(keyed(seed, "rerank", "did"), "did").limit(n_queries).select(F.col("did").alias("qid"), F.col("h").alias("qh"), F.col("k").alias("qk")).persist()
    try:
        q.count()
        few = F.broadcast(q)  # n_queries rows
        relevant = known.join(few, F.col("k") == F.col("qk")).where("h <> qh").select("qid", "did", F.lit(1).alias("rel"))
        own = known.join(F.broadcast(q.select("qh").distinct()), F.col("h") == F.col("qh"), "left_semi")
        ring = numbered(own, keyed(seed, "hard", "did"), "did", "h")
        mine = known.join(few, (F.col("h") == F.col("qh")) & (F.col("k") == F.col("qk"))).groupBy("qid").agg(F.count("*").alias("mine"))
        sizes = ring.groupBy("h").agg(F.max("size").alias("size"))
        spare = F.col("mine") if apart else F.lit(1)  # rows of the run that may not count
        steps = q.join(sizes, q["qh"] == sizes["h"]).join(mine, "qid").select("qid", "qh", "qk", "size", F.explode(F.sequence(F.lit(0), F.least(F.col("size"), n_hard + spare).cast("int") - 1)).alias("step"))
        steps = steps.withColumn("place", (keyed(seed, "start", "qid") + F.col("step")) % F.col("size"))
        met = steps.drop("size").join(ring.drop("size"), [steps["qh"] == ring["h"], steps["place"] == ring["place"]]).where("k <> qk" if apart else "did <> qid")
        hard = met.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("step"))).where(F.col("r") <= n_hard).select("qid", "did", F.lit(0).alias("rel"))
        parts = relevant.unionByName(hard)
        if n_easy:
            every = numbered(known, keyed(seed, "easy", "did"), "did")
            total = known.agg(F.count("*").alias("size"))
            picks = q.select("qid").crossJoin(F.broadcast(total)).select("qid", "size", F.explode(F.sequence(F.lit(0), F.least(F.col("size"), F.lit(n_easy)).cast("int") - 1)).alias("step"))
            picks = picks.select("qid", ((keyed(seed, "any", "qid") + F.col("step")) % F.col("size")).alias("place"))
            easy = every.select("did", "place").join(F.broadcast(picks), "place").where("did <> qid").select("qid", "did", F.lit(0).alias("rel"))
            parts = parts.unionByName(easy)
        out = parts.groupBy("qid", "did").agg(F.max("rel").alias("rel"))
        some = out.where("rel = 0").select("qid").distinct()
        return out.join(F.broadcast(some), "qid", "left_semi")
    finally:
        q.unpersist()


def closure(found: DataFrame) -> DataFrame:
    """The corpus that the candidate rows point into: id, is_query, n_positive and n_negative of its own list, and n_lists, how many lists it is in. Every query is in it."""
    lists = found.groupBy(F.col("qid").alias("id")).agg(F.sum("rel").alias("n_positive"), F.sum(1 - F.col("rel")).alias("n_negative"))
    members = found.groupBy(F.col("did").alias("id")).agg(F.count("*").alias("n_lists"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return members.join(lists, "id", "full").select("id", F.col("n_positive").isNotNull().alias("is_query"), zero("n_positive").alias("n_positive"), zero("n_negative").alias("n_negative"), zero("n_lists").alias("n_lists"))


def bitmaps(found: DataFrame, corpus: DataFrame, seed: int) -> DataFrame:
    """qid, bucket, members and relevant: each list as bits over the corpus's places in a keyed order, 32,768 to a bucket."""
    placed = numbered(corpus.select("id"), keyed(seed, "corpus", "id"), "id").select(F.col("id").alias("did"), "place")
    at = found.join(placed, "did").select("qid", "rel", F.call_function("bitmap_bucket_number", F.col("place") + 1).alias("bucket"), F.call_function("bitmap_bit_position", F.col("place") + 1).alias("bit"))
    bits = lambda c: F.call_function("bitmap_construct_agg", c)
    return at.groupBy("qid", "bucket").agg(bits(F.col("bit")).alias("members"), bits(F.when(F.col("rel") == 1, F.col("bit"))).alias("relevant"))


def candidates_sql(rows: str, n_queries: int, n_hard: int, n_easy: int, seed: int, apart: bool) -> str:
    """Common tables ending in ``cands`` (qid, did, rel) in DuckDB, from ``rows`` (did, h, k)."""
    key = lambda salt, c: keyed_sql(seed, salt, c)
    out = f"""kn AS (SELECT * FROM {rows} WHERE h IS NOT NULL AND k IS NOT NULL),
qs AS (SELECT did AS qid, h AS qh, k AS qk FROM kn WHERE k IN (SELECT k FROM kn GROUP BY k HAVING count(DISTINCT h) > 1) ORDER BY {key("rerank", "did")}, did LIMIT {n_queries}),
rh AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY {key("hard", "did")}, did) - 1 AS place, count(*) OVER (PARTITION BY h) AS size FROM kn),
hd AS (SELECT qid, did FROM qs JOIN rh ON h = qh WHERE {"k <> qk" if apart else "did <> qid"} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY (place - {key("start", "qid")} % size + size) % size) <= {n_hard}),
un AS (SELECT qid, did, 1 AS rel FROM qs JOIN kn ON k = qk AND h <> qh UNION ALL SELECT qid, did, 0 FROM hd"""
    if n_easy:
        out = out.replace("un AS (", f"ra AS (SELECT *, row_number() OVER (ORDER BY {key('easy', 'did')}, did) - 1 AS place, count(*) OVER () AS size FROM kn),\nun AS (")
        out += f" UNION ALL SELECT qid, did, 0 FROM qs CROSS JOIN ra WHERE did <> qid AND (place - {key('any', 'qid')} % size + size) % size < {n_easy}"
    return out + """),
cands AS (SELECT qid, did, max(rel) AS rel FROM un GROUP BY 1, 2 QUALIFY min(max(rel)) OVER (PARTITION BY qid) = 0)"""
