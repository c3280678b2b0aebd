"""The roles that the test tables play, as DataFrames and as SQL, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.keyed import keyed, keyed_sql
from ..operators.sampling import normal_text
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name; ``sql`` is the same in DuckDB, with {scores}, {meta}, {manifest} and {vectors} as common tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.format(**SQL)
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


CAPABILITIES = ["channel", "content", "speaker"]
EVENTS = ("click", "error", "purchase", "signup", "view")


def mean6(where: Column | None = None) -> Column:
    """The mean score to six places, halves up, from whole millionths: the same in any order of the rows. For an aggregation; ``where`` picks rows."""
    u = F.col("u") if where is None else F.when(where, F.col("u"))
    twice = 2 * F.sum(u) + F.count(u)
    n = F.nullif(2 * F.count(u), F.lit(0))
    return ((twice - F.pmod(twice, n)) / n).cast("long") / 1e6


def mean6_sql(where: str = "") -> str:
    """The same in DuckDB."""
    f = f" FILTER (WHERE {where})" if where else ""
    return f"((2 * sum(u){f} + count(u){f}) // nullif(2 * count(u){f}, 0))::DOUBLE / 1e6::DOUBLE"


def scores(spark: SparkSession, d: str) -> DataFrame:
    """model, task, family, capability, corpus, u and score: one score for each model and task, as whole millionths and as a number.

    Sums are of whole numbers (hundredths times quantity), so a score doesn't depend on their order.
    """
    t = lambda n: table(spark, d, n)
    small = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    models = t("supplier").join(F.broadcast(small), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("model"), F.col("r_name").alias("family"))
    rows = t("lineitem").select("l_suppkey", "l_partkey", "l_discount", "l_quantity").join(models, F.col("l_suppkey") == F.col("s_suppkey")).join(t("part").select("p_partkey", F.col("p_brand").alias("task")), F.col("l_partkey") == F.col("p_partkey"))
    cents = F.round(F.col("l_discount") * 100).cast("long") * F.round(F.col("l_quantity")).cast("long")
    whole = rows.groupBy("model", "task", "family").agg((20_000 * F.sum(cents) + F.count("*")).alias("s"), (2 * F.count("*")).alias("n"))
    out = whole.withColumn("u", ((F.col("s") - F.pmod("s", "n")) / F.col("n")).cast("long")).withColumn("score", F.col("u") / 1e6)
    number = F.regexp_extract("task", r"(\d+)", 1).cast("int")
    capability = F.element_at(F.array(*[F.lit(x) for x in ("speaker", "content", "channel")]), number % 3 + 1)
    return out.select("model", "task", "family", capability.alias("capability"), F.concat(F.lit("corpus"), (number % 5).cast("string")).alias("corpus"), "u", "score")


def sparse(spark: SparkSession, d: str) -> DataFrame:
    """The scores with one in forty cells empty."""
    return scores(spark, d).withColumn("score", F.when(keyed(2, "gap", "model", "task") % 40 > 0, F.col("score")))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """utt_id, speaker_id, dataset, transcript, duration, norm (the normalised transcript)."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("utt_id"), F.col("source").alias("speaker_id"), F.col("lang").alias("dataset"), F.col("text").alias("transcript"), F.col("n_chars").alias("duration"), normal_text(F.col("text")).alias("norm"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """id, label, vec: unit vectors."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", V.unit(V.doubles(F.col("embedding"))).alias("vec"))


SQL = {
    "scores": """joined AS (SELECT n_name AS model, p_brand AS task, r_name AS family, ((20000 * sum(round(l_discount * 100)::BIGINT * round(l_quantity)::BIGINT) + count(*)) // (2 * count(*)))::BIGINT AS u, u / 1e6::DOUBLE AS score
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
scores AS (SELECT model, task, family, (['speaker', 'content', 'channel'])[regexp_extract(task, '(\\d+)', 1)::INT % 3 + 1] AS capability, 'corpus' || (regexp_extract(task, '(\\d+)', 1)::INT % 5) AS corpus, u, score FROM joined),
nm AS (SELECT count(DISTINCT model)::DOUBLE AS n_models FROM scores),
ranked AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY score DESC) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0::DOUBLE AS r FROM scores)""",
    "sparse": "sparse AS (SELECT * REPLACE (CASE WHEN " + keyed_sql(2, "gap", "model", "task") + " % 40 > 0 THEN score END AS score) FROM scores)",
    "manifest": """manifest AS (SELECT doc_id AS utt_id, source AS speaker_id, lang AS dataset, text AS transcript, n_chars AS duration, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS norm FROM documents)""",
    "vectors": """raw AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
vectors AS (SELECT id, label, list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-8)) AS vec FROM raw)""",
    "sims": """sims AS (SELECT q.id AS qid, d.id AS did, q.label AS ql, d.label AS dl, round(list_inner_product(q.vec, d.vec), 12) AS sim FROM vectors q JOIN vectors d ON q.id <> d.id),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, did) AS rn, (ql = dl)::INT AS rel FROM sims)""",
    "pairs": """duo AS (SELECT a.task AS task_a, b.task AS task_b, a.model, a.score AS x, b.score AS y, a.capability AS ca, b.capability AS cb FROM scores a JOIN scores b ON a.model = b.model AND a.task < b.task)""",
}
