"""Parts of the larger analyses beside their main table: places, scale, tests of correlations, pairs and triplets inside a pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keyed import keyed, keyed_sql
from ..operators import ranking, sampling, stats
from .base import manifest, mean6, mean6_sql, query, r6, scores, vectors
from .corpora import silhouette

TAU = "round(sum(sx * sy) / sqrt((sum(sx * sx) * sum(sy * sy))::DOUBLE), 6)"


# places


@query("""WITH {scores}, per AS (SELECT model, capability, avg(r) AS m FROM ranked GROUP BY 1, 2),
c AS (SELECT model, max(m) FILTER (WHERE capability = 'speaker') AS speaker, max(m) FILTER (WHERE capability = 'content') AS content, max(m) FILTER (WHERE capability = 'channel') AS channel, round(avg(m) FILTER (WHERE capability <> 'channel'), 9) AS b FROM per GROUP BY 1),
p AS (SELECT model, rank() OVER (ORDER BY sum(n_models - r) DESC) AS borda FROM ranked, nm GROUP BY 1),
t AS (SELECT *, rank() OVER (ORDER BY b NULLS LAST) AS balanced FROM c JOIN p USING (model)),
q AS (SELECT sign(x.balanced - y.balanced) AS sx, sign(x.borda - y.borda) AS sy FROM t x JOIN t y ON x.model < y.model)
SELECT model, round(speaker, 6) AS speaker, round(content, 6) AS content, round(channel, 6) AS channel, balanced::BIGINT AS balanced, borda::BIGINT AS borda, (SELECT """ + TAU + """ FROM q) AS tau FROM t""")
def qry05_against_borda(spark: SparkSession, d: str) -> DataFrame:
    """Mean rank in each capability, places by speaker and content alike and by Borda points, and tau of the two (QRY05)."""
    s = scores(spark, d)
    per = s.withColumn("r", ranking.rank_ties(["task"], F.desc("score"), ["score"])).groupBy("model", "capability").agg(F.avg("r").alias("m"))
    one = lambda c: F.max(F.when(F.col("capability") == c, F.col("m"))).alias(c)
    c = per.groupBy("model").agg(one("speaker"), one("content"), one("channel"), F.round(F.avg(F.when(F.col("capability") != "channel", F.col("m"))), 9).alias("b"))
    t = c.join(ranking.borda(s).select("model", F.col("rank").alias("borda")), "model").withColumn("balanced", F.rank().over(Window.orderBy(F.asc_nulls_last("b"))).cast("long"))
    tau = stats.kendall(t, [], "model", "balanced", "borda").select(r6("tau").alias("tau"))
    return t.crossJoin(F.broadcast(tau)).select("model", r6("speaker").alias("speaker"), r6("content").alias("content"), r6("channel").alias("channel"), "balanced", F.col("borda").cast("long").alias("borda"), "tau")


@query("WITH {scores}, m AS (SELECT family, capability, regexp_extract(model, '(\\d+)', 1)::INT AS params, " + mean6_sql() + """ AS s FROM scores GROUP BY model, 1, 2, 3),
k AS (SELECT *, rank() OVER (PARTITION BY family, capability ORDER BY params) + (count(*) OVER (PARTITION BY family, capability, params) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY family, capability ORDER BY s) + (count(*) OVER (PARTITION BY family, capability, s) - 1) / 2.0::DOUBLE AS ry FROM m)
SELECT family, capability, count(*) AS n_sizes, round(corr(rx, ry), 6) + 0 AS rho FROM k GROUP BY 1, 2 HAVING count(*) >= 3""")
def qry11_scale_rho(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of a model's size and its mean score, by family of three models or more and capability (QRY11)."""
    m = scores(spark, d).groupBy("model", "family", "capability").agg(mean6().alias("s")).withColumn("params", F.regexp_extract("model", r"(\d+)", 1).cast("int"))
    return stats.spearman(m, ["family", "capability"], "params", "s").where("n >= 3").select("family", "capability", F.col("n").alias("n_sizes"), (r6("rho") + 0.0).alias("rho"))


SCHEMES = ("all_tasks", "core_tasks", "reweighted")
DECOMPOSED = """WITH {scores}, low AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY score DESC) AS k FROM scores WHERE NOT starts_with(model, 'NATION_1')),
a AS (SELECT model, round(avg(k), 9) AS a, round(avg(k) FILTER (WHERE contains(task, '1')), 9) AS b FROM low GROUP BY 1),
c AS (SELECT model, round(avg(m), 9) AS c FROM (SELECT model, capability, avg(k) AS m FROM low WHERE capability <> 'channel' GROUP BY 1, 2) GROUP BY 1),
agg AS (SELECT model, rank() OVER (ORDER BY a NULLS LAST)::BIGINT AS all_tasks, rank() OVER (ORDER BY b NULLS LAST)::BIGINT AS core_tasks, rank() OVER (ORDER BY c NULLS LAST)::BIGINT AS reweighted FROM a LEFT JOIN c USING (model))"""


def _decomposed(s: DataFrame) -> DataFrame:
    low = s.where(~F.col("model").startswith("NATION_1")).withColumn("k", F.rank().over(Window.partitionBy("task").orderBy(F.desc("score"))))
    plain = low.groupBy("model").agg(F.round(F.avg("k"), 9).alias("a"), F.round(F.avg(F.when(F.col("task").contains("1"), F.col("k"))), 9).alias("b"))
    even = low.where("capability <> 'channel'").groupBy("model", "capability").agg(F.avg("k").alias("m")).groupBy("model").agg(F.round(F.avg("m"), 9).alias("c"))
    place = lambda c: F.rank().over(Window.orderBy(F.asc_nulls_last(c))).cast("long")
    return plain.join(even, "model", "left").select("model", *[place(c).alias(n) for c, n in zip("abc", SCHEMES, strict=True)])


@query(DECOMPOSED + " SELECT * FROM agg")
def qry17_decomposed(spark: SparkSession, d: str) -> DataFrame:
    """Places without the control rows by mean rank over all tasks, over the core tasks, and over speaker and content alike (QRY17)."""
    return _decomposed(scores(spark, d))


@query(DECOMPOSED + """, l AS (UNPIVOT agg ON all_tasks, core_tasks, reweighted INTO NAME scheme VALUE place),
p AS (SELECT a.scheme AS scheme_a, b.scheme AS scheme_b, a.model, a.place AS x, b.place AS y FROM l a JOIN l b ON a.model = b.model AND a.scheme < b.scheme),
q AS (SELECT a.scheme_a, a.scheme_b, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM p a JOIN p b ON a.scheme_a = b.scheme_a AND a.scheme_b = b.scheme_b AND a.model < b.model)
SELECT scheme_a, scheme_b, """ + TAU + """ AS tau FROM q GROUP BY 1, 2""")
def qry17_scheme_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Kendall's tau of each two of the three (QRY17)."""
    rows = _decomposed(scores(spark, d)).unpivot("model", list(SCHEMES), "scheme", "place")
    both = rows.toDF("model", "scheme_a", "x").join(rows.toDF("model", "scheme_b", "y"), "model").where("scheme_a < scheme_b")
    return stats.kendall(both, ["scheme_a", "scheme_b"], "model", "x", "y").withColumn("tau", r6("tau"))


# tests of correlations


@query("""WITH {scores}, {pairs}, rk AS (SELECT *, rank() OVER (PARTITION BY task_a, task_b ORDER BY x) + (count(*) OVER (PARTITION BY task_a, task_b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY task_a, task_b ORDER BY y) + (count(*) OVER (PARTITION BY task_a, task_b, y) - 1) / 2.0::DOUBLE AS ry FROM duo),
rho AS (SELECT task_a, task_b, count(*) AS n, round(corr(rx, ry), 6) + 0 AS rho FROM rk GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT task_a, task_b, n, rho, """ + stats.spearman_p_sql("rho", "n") + " AS p FROM rho")
def sta04_spearman_p(spark: SparkSession, d: str) -> DataFrame:
    """Two-sided p of each task pair's rank correlation, by Student's t with n - 2 degrees (STA04)."""
    s = scores(spark, d)
    a, b = s.select("model", F.col("task").alias("task_a"), F.col("score").alias("x")), s.select("model", F.col("task").alias("task_b"), F.col("score").alias("y"))
    rho = stats.spearman(a.join(b, "model").where("task_a < task_b"), ["task_a", "task_b"], "x", "y").where("n >= 3").withColumn("rho", r6("rho") + 0.0)
    return rho.select("task_a", "task_b", "n", "rho", r6(stats.spearman_p(F.col("rho"), F.col("n"))).alias("p"))


# pairs, triplets and groups inside a pool


POOL = keyed_sql(9, "half", "utt_id") + " % 2 = 0"


@query("""WITH {manifest}, p AS (SELECT utt_id, speaker_id, md5(norm) AS k, length(norm) > 0 AS some FROM manifest WHERE """ + POOL + """),
c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY """ + keyed_sql(3, "content", "utt_id") + """, utt_id) AS i FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY """ + keyed_sql(3, "speaker", "utt_id") + """, utt_id) AS i FROM p),
x AS (SELECT a.utt_id AS q, arg_min(b.utt_id, (b.i < a.i, b.i)) AS content FROM c a JOIN c b ON a.k = b.k AND a.speaker_id <> b.speaker_id WHERE a.some GROUP BY 1),
y AS (SELECT a.utt_id AS q, arg_min(b.utt_id, (b.i < a.i, b.i)) AS speaker FROM s a JOIN s b ON a.speaker_id = b.speaker_id AND a.k <> b.k GROUP BY 1)
SELECT q, content, speaker FROM x JOIN y USING (q)""")
def smp15_pool_triplets(spark: SparkSession, d: str) -> DataFrame:
    """Inside one half of the rows: q, content (same text, other speaker) and speaker (same speaker, other text), each the next such row in a keyed order that closes in a ring (SMP15)."""
    p = manifest(spark, d).where(keyed(9, "half", "utt_id") % 2 == 0).select("utt_id", "speaker_id", F.md5("norm").alias("k"), (F.length("norm") > 0).alias("some"))
    content = sampling.next_other(p.where("some"), "k", "speaker_id", "utt_id", "content", seed=3).select(F.col("utt_id").alias("q"), F.col("other").alias("content"))
    speaker = sampling.next_other(p, "speaker_id", "k", "utt_id", "speaker", seed=3).select(F.col("utt_id").alias("q"), F.col("other").alias("speaker"))
    return content.where("content IS NOT NULL").join(speaker.where("speaker IS NOT NULL"), "q")


PAIRS_WANTED, TRIES = 400, 16


def _draw(salt: str) -> str:
    return keyed_sql(5, salt, "i")


DRAWN = """WITH {manifest}, t AS (SELECT utt_id, speaker_id, md5(norm) AS k FROM manifest WHERE length(norm) > 0 AND speaker_id IS NOT NULL),
g AS (SELECT k, count(*) AS n FROM t GROUP BY 1 HAVING count(DISTINCT speaker_id) >= 2),
gn AS (SELECT k, n, row_number() OVER (ORDER BY k) - 1 AS gi, count(*) OVER () AS m FROM g),
r AS (SELECT t.*, gi, row_number() OVER (PARTITION BY k ORDER BY utt_id) - 1 AS j FROM t JOIN gn USING (k)),
al AS (SELECT *, row_number() OVER (ORDER BY """ + keyed_sql(5, "row", "utt_id") + """ % 4096, utt_id) - 1 AS w, count(*) OVER () AS total FROM r),
dr AS (SELECT i FROM range(TRIES_) z(i)),
pa AS (SELECT i, gi, n, """ + _draw("a") + """ % n AS ja, """ + _draw("b") + """ AS hb FROM dr JOIN gn ON gi = """ + _draw("group") + """ % m),
pos AS (SELECT i, least(a.utt_id, b.utt_id) AS id_a, greatest(a.utt_id, b.utt_id) AS id_b, 1 AS label FROM pa JOIN r a ON a.gi = pa.gi AND a.j = ja JOIN r b ON b.gi = pa.gi AND b.j = (ja + 1 + hb % (n - 1)) % n WHERE a.speaker_id <> b.speaker_id ORDER BY i LIMIT HALF_),
neg AS (SELECT i, least(a.utt_id, b.utt_id) AS id_a, greatest(a.utt_id, b.utt_id) AS id_b, 0 AS label FROM dr JOIN al a ON a.w = """ + _draw("x") + """ % a.total JOIN al b ON b.w = """ + _draw("y") + """ % b.total WHERE a.gi <> b.gi AND a.speaker_id <> b.speaker_id ORDER BY i LIMIT HALF_)
SELECT * FROM pos UNION ALL SELECT * FROM neg"""


@query(DRAWN.replace("TRIES_", str(TRIES * PAIRS_WANTED)).replace("HALF_", str(PAIRS_WANTED // 2)))
def smp05_content_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs drawn with replacement: same text by two speakers, groups drawn uniformly, and other texts by two speakers (SMP05)."""
    t = manifest(spark, d).where("length(norm) > 0 AND speaker_id IS NOT NULL").select("utt_id", "speaker_id", F.md5("norm").alias("k"))
    return sampling.content_pairs(t, "k", "speaker_id", "utt_id", PAIRS_WANTED, TRIES, seed=5)


GROUPED = "grouped AS (SELECT * FROM vectors QUALIFY count(*) OVER (PARTITION BY label) >= 4)"


@query("""WITH {vectors}, """ + GROUPED + """, x AS (SELECT id, label, unnest(vec) AS v, generate_subscripts(vec, 1) AS p FROM grouped), c AS (SELECT label, p, sum(v) AS s FROM x GROUP BY 1, 2), k AS (SELECT label, count(*)::DOUBLE AS n FROM grouped GROUP BY 1),
d AS (SELECT x.id, x.label, c.label AS other, sum(x.v * c.s) AS dp FROM x JOIN c USING (p) GROUP BY 1, 2, 3),
e AS (SELECT d.id, d.label, other, CASE WHEN d.label = other THEN (n - dp) / nullif(n - 1, 0) ELSE (n - dp) / n END AS m FROM d JOIN k ON k.label = other),
g AS (SELECT id, max(m) FILTER (WHERE label = other) AS a, min(m) FILTER (WHERE label <> other) AS b FROM e GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM g""")
def clu10_group_silhouette(spark: SparkSession, d: str) -> DataFrame:
    """The silhouette of rows in groups of four or more alone (CLU10)."""
    n = F.count("*").over(Window.partitionBy("label"))
    return silhouette(vectors(spark, d).withColumn("n_own", n).where("n_own >= 4").drop("n_own"))
