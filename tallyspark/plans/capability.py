"""Capability rankings and what they have in common: exact tests, groups, selection guided by other tasks (QRY23, STA02, STA04, STA05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranks, stats
from ..session import table
from .base import mean6, mean6_sql, query, r6, scores

FAMILY_DRAWS = 2000

#: Shares of the permutations of n rows with each number of inversions, and ways to choose c of n ranks by the excess of their sum.
INVERSIONS = """perm(n, c) AS (SELECT 1, [1.0::DOUBLE] UNION ALL SELECT n + 1, list_transform(range(0, (n + 1) * n // 2 + 1), lambda k: list_sum(list_transform(range(greatest(0, k - n), least(k, n * (n - 1) // 2) + 1), lambda j: c[j + 1])) / (n + 1)) FROM perm WHERE n < 33)"""
CHOICES = """ways(n, w) AS (SELECT 0, list_transform(range(0, 9), lambda c: list_transform(range(0, 400), lambda s: (CASE WHEN c = 0 AND s = 0 THEN 1 ELSE 0 END)::DOUBLE))
UNION ALL SELECT n + 1, list_transform(range(0, 9), lambda c: list_transform(range(0, 400), lambda s: w[c + 1][s + 1] + CASE WHEN c > 0 AND n + 1 >= c AND s >= n + 1 - c THEN w[c][s - (n + 1 - c) + 1] ELSE 0 END)) FROM ways WHERE n < 40)"""


def tau_sql(duo: str, by: str) -> str:
    """Common tables t (``by``, n, dis, x2, y2, room, lead, var) and tau (with tau, z and p) from all pairs of rows of ``duo`` (``by``, item, x, y)."""
    cell = lambda c: f"(SELECT {by}, sum(t * (t - 1) / 2.0::DOUBLE) AS two, sum(t * (t - 1.0::DOUBLE) * (t - 2)) AS three, sum(t * (t - 1.0::DOUBLE) * (2 * t + 5)) AS five FROM (SELECT {by}, count(*) AS t FROM {duo} GROUP BY {by}, {c}) GROUP BY {by})"
    return f"""pr AS (SELECT {by}, count(*) FILTER (WHERE (a.x < b.x AND a.y > b.y) OR (a.x > b.x AND a.y < b.y)) AS dis FROM {duo} a JOIN {duo} b USING ({by}) WHERE a.item < b.item GROUP BY {by}),
sz AS (SELECT {by}, count(*) AS n FROM {duo} GROUP BY {by}), tx AS {cell("x")}, ty AS {cell("y")}, txy AS {cell("x, y")},
t AS (SELECT {by}, n, coalesce(dis, 0) AS dis, tx.two AS x2, ty.two AS y2, n * (n - 1) / 2.0::DOUBLE AS whole, (whole - x2) * (whole - y2) AS room, whole - x2 - y2 + txy.two - 2 * dis AS lead,
 (n * (n - 1) * (2 * n + 5) - tx.five - ty.five) / 18.0::DOUBLE + 2 * x2 * y2 / (n * (n - 1)) + coalesce(tx.three * ty.three / nullif(9.0::DOUBLE * n * (n - 1) * (n - 2), 0), 0) AS var FROM sz LEFT JOIN pr USING ({by}) JOIN tx USING ({by}) JOIN ty USING ({by}) JOIN txy USING ({by})),
tau AS (SELECT t.*, CASE WHEN room > 0 THEN lead / sqrt(room) END AS tau, CASE WHEN room > 0 AND var > 0 THEN lead / sqrt(var) END AS z, x2 = 0 AND y2 = 0 AND n <= 33 AND room > 0 AS exact,
 CASE WHEN 2 * least(dis, whole - dis) >= whole OR n < 3 THEN 1 ELSE least(1, 2 * list_sum(perm.c[:least(dis, whole - dis)::BIGINT + 1])) END AS px FROM t LEFT JOIN perm USING (n))"""


@query("WITH RECURSIVE {scores}, " + INVERSIONS + ", duo AS (SELECT a.task || '|' || b.task AS pair, a.model AS item, a.score AS x, b.score AS y FROM scores a JOIN scores b ON a.model = b.model AND a.task < b.task), " + tau_sql("duo", "pair") + f"""
SELECT split_part(pair, '|', 1) AS task_a, split_part(pair, '|', 2) AS task_b, n, dis::BIGINT AS opposite, round(tau, 6) AS tau, exact, round(CASE WHEN exact THEN px ELSE {stats.two_sided_sql("z")} END, 6) AS p FROM tau WHERE n >= 3""")
def sta04_kendall_p(spark: SparkSession, d: str) -> DataFrame:
    """Tau of each task pair over models and its two-sided p, exact from the counts of permutations (STA02, STA04)."""
    s = scores(spark, d)
    duo = s.select("model", F.col("task").alias("task_a"), F.col("score").alias("x")).join(s.select("model", F.col("task").alias("task_b"), F.col("score").alias("y")), "model").where("task_a < task_b")
    return ranks.kendalls(duo, ["task_a", "task_b"], "x", "y").where("n >= 3").select("task_a", "task_b", "n", "opposite", r6("tau").alias("tau"), "exact", r6("p").alias("p"))


@query(f"""WITH c AS (SELECT l_quantity::DOUBLE AS x, l_discount::DOUBLE AS y, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2), k AS (SELECT sum(w) AS n FROM c),
dis AS (SELECT sum(a.w * b.w) AS dis FROM c a JOIN c b ON a.x < b.x AND a.y > b.y), x AS (SELECT sum(w) AS t FROM c GROUP BY x), y AS (SELECT sum(w) AS t FROM c GROUP BY y),
tx AS (SELECT sum(t * (t - 1) / 2) AS x2, sum(t * (t - 1) * (t - 2)) AS x3, sum(t * (t - 1) * (2 * t + 5)) AS x5 FROM x), ty AS (SELECT sum(t * (t - 1) / 2) AS y2, sum(t * (t - 1) * (t - 2)) AS y3, sum(t * (t - 1) * (2 * t + 5)) AS y5 FROM y), txy AS (SELECT sum(w * (w - 1) / 2) AS xy FROM c),
s AS (SELECT *, n * (n - 1) / 2 AS whole, (n * (n - 1) * (2 * n + 5) - x5 - y5) / 18 + 2 * x2 * y2 / (n * (n - 1)) + x3 * y3 / (9 * n * (n - 1) * (n - 2)) AS var FROM k, dis, tx, ty, txy),
z AS (SELECT *, (whole - x2 - y2 + xy - 2 * dis) / sqrt(var) AS z FROM s) SELECT n::BIGINT AS n, dis::BIGINT AS opposite, round((whole - x2 - y2 + xy - 2 * dis) / sqrt((whole - x2) * (whole - y2)), 9) AS tau, round(z, 6) AS z, round({stats.two_sided_sql("z")}, 6) AS p FROM z""")
def sta02_large_tau(spark: SparkSession, d: str) -> DataFrame:
    """Tau of two columns over all rows of one table, from inversions in blocks (STA02, STA04)."""
    out = ranks.kendall_large(table(spark, d, "lineitem"), "l_quantity", "l_discount")
    return out.select("n", "opposite", F.round("tau", 9).alias("tau"), r6("z").alias("z"), r6("p").alias("p"))


@query("WITH RECURSIVE {scores}, " + CHOICES + f""", f AS (SELECT DISTINCT family AS fam FROM scores), g AS (SELECT task, fam, score, family = fam AS own FROM scores CROSS JOIN f),
u AS (SELECT a.task, a.fam, sum((a.score > b.score)::INT + (a.score = b.score)::INT / 2.0::DOUBLE) AS u FROM g a JOIN g b ON a.task = b.task AND a.fam = b.fam AND a.own AND NOT b.own GROUP BY 1, 2),
tt AS (SELECT task, sum(t * (t * t - 1.0::DOUBLE)) AS ties FROM (SELECT task, score, count(*) AS t FROM scores GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT task, fam, count(*) FILTER (WHERE own) AS n1, count(*) FILTER (WHERE NOT own) AS n2 FROM g GROUP BY 1, 2),
r AS (SELECT s.*, u, ties, n1 + n2 AS n, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0::DOUBLE - 0.5::DOUBLE) / nullif(sqrt(n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0) AS z, ties = 0 AND least(n1, n2) <= 8 AS exact FROM s JOIN u USING (task, fam) JOIN tt USING (task) WHERE n1 > 0 AND n2 > 0)
SELECT task, fam AS family, n1, n2, u, exact, round(CASE WHEN exact THEN least(1, 2 * list_sum(w[least(n1, n2) + 1][:least(u, n1 * n2 - u)::BIGINT + 1]) / list_sum(w[least(n1, n2) + 1])) WHEN z <= 0 THEN 1 ELSE {stats.two_sided_sql("z")} END, 6) AS p FROM r JOIN ways USING (n)""")
def sta05_family_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Whether a family's models rank apart from the others on a task: exact rank sum tests of small groups (STA05)."""
    s = scores(spark, d)
    families = s.select(F.col("family").alias("fam")).distinct()
    g = s.select("task", "family", "score").crossJoin(F.broadcast(families)).select("task", "fam", "score", (F.col("family") == F.col("fam")).alias("own"))  # families are few
    out = ranks.rank_sums(g, ["task", "fam"], "score", "own").where("n1 > 0 AND n2 > 0")
    return out.select("task", F.col("fam").alias("family"), "n1", "n2", "u", "exact", r6("p").alias("p"))


CAP = "cap AS (SELECT model, family, " + mean6_sql("capability = 'speaker'") + " AS speaker, " + mean6_sql("capability = 'content'") + " AS content, " + mean6_sql("capability = 'channel'") + " AS channel, regexp_extract(model, '(\\d+)', 1)::INT AS size FROM scores GROUP BY ALL)"
RANKED = CAP + ", rk AS (SELECT *, rank() OVER (ORDER BY speaker DESC)::BIGINT AS rank_speaker, rank() OVER (ORDER BY content DESC)::BIGINT AS rank_content FROM cap)"


def _cap(spark: SparkSession, d: str) -> DataFrame:
    """model, family, size (the number in its name) and the mean score of each capability: a row for each model, of which there are few."""
    return scores(spark, d).groupBy("model", "family").agg(*[mean6(F.col("capability") == c).alias(c) for c in ("speaker", "content", "channel")]).withColumn("size", F.regexp_extract("model", r"(\d+)", 1).cast("int"))


def _ranked(cap: DataFrame) -> DataFrame:
    place = lambda c: F.rank().over(Window.orderBy(F.desc(c))).cast("long")
    return cap.withColumn("rank_speaker", place("speaker")).withColumn("rank_content", place("content"))


@query("WITH {scores}, " + RANKED.replace("{", "{{").replace("}", "}}") + " SELECT model, family, size, speaker, content, rank_speaker, rank_content, rank_speaker - rank_content AS rank_gap FROM rk")
def qry23_rankings(spark: SparkSession, d: str) -> DataFrame:
    """All models by both capabilities, tied scores sharing the better rank, and how far the ranks lie apart (QRY23 Y1)."""
    return _ranked(_cap(spark, d)).select("model", "family", "size", "speaker", "content", "rank_speaker", "rank_content", (F.col("rank_speaker") - F.col("rank_content")).alias("rank_gap"))


@query("WITH {scores}, " + CAP + " SELECT family, count(*) AS n, round(avg(speaker), 6) AS speaker_mean, round(stddev_samp(speaker), 6) AS speaker_sd, round(avg(content), 6) AS content_mean, round(stddev_samp(content), 6) AS content_sd, median(size)::DOUBLE AS size_median FROM cap GROUP BY 1")
def qry23_groups(spark: SparkSession, d: str) -> DataFrame:
    """Both capabilities by group of models: counts, means, deviations and the median size (QRY23 Y2)."""
    stat = [x for c in ("speaker", "content") for x in (r6(F.avg(c)).alias(f"{c}_mean"), r6(F.stddev_samp(c)).alias(f"{c}_sd"))]
    return _cap(spark, d).groupBy("family").agg(F.count("*").alias("n"), *stat, F.percentile("size", 0.5).alias("size_median"))


@query("WITH {scores}, " + RANKED + """, nmod AS (SELECT count(*) AS n FROM cap), full_tasks AS (SELECT task FROM scores, nmod WHERE capability = 'channel' GROUP BY task, n HAVING count(*) = n),
part AS (SELECT 'all' AS subset, task, model, u FROM scores JOIN full_tasks USING (task) UNION ALL SELECT corpus, task, model, u FROM scores JOIN full_tasks USING (task)),
x AS (SELECT subset, model, count(*) AS n_tasks, """ + mean6_sql() + """ AS x FROM part GROUP BY 1, 2), pl AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY x DESC, model) AS place FROM x)
SELECT subset, n_tasks, k::INT AS top_k, string_agg(model, '; ' ORDER BY place) AS picked, round(avg(rank_speaker), 6) AS mean_speaker_rank, round(avg(rank_content), 6) AS mean_content_rank, (any_value(n) + 1) / 2.0::DOUBLE AS random_rank, any_value(n) AS n_models
FROM pl JOIN rk USING (model) CROSS JOIN nmod CROSS JOIN (SELECT unnest([1, 3, 5]) AS k) WHERE place <= k GROUP BY 1, 2, 3""")
def qry23_guided_selection(spark: SparkSession, d: str) -> DataFrame:
    """The models that another benchmark (the channel tasks that all models have, all of them or by corpus) puts first, and their mean ranks here (QRY23 Y3)."""
    s, cap = scores(spark, d), _cap(spark, d)
    n = cap.agg(F.count("*").alias("n"))
    full = s.where("capability = 'channel'").groupBy("task").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).where("k = n").select("task")
    of = s.join(full, "task").select(F.explode(F.array(F.lit("all"), "corpus")).alias("subset"), "model", "u")
    x = of.groupBy("subset", "model").agg(F.count("*").alias("n_tasks"), mean6().alias("x"))
    first = x.withColumn("place", F.row_number().over(Window.partitionBy("subset").orderBy(F.desc("x"), "model"))).where("place <= 5")
    each = first.join(_ranked(cap).select("model", "rank_speaker", "rank_content"), "model").withColumn("top_k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))).where("place <= top_k")
    picked = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "model"))), lambda p: p["model"]), "; ")  # five at most
    out = each.groupBy("subset", "n_tasks", "top_k").agg(picked.alias("picked"), r6(F.avg("rank_speaker")).alias("mean_speaker_rank"), r6(F.avg("rank_content")).alias("mean_content_rank"))
    return out.crossJoin(F.broadcast(n)).select("subset", "n_tasks", "top_k", "picked", "mean_speaker_rank", "mean_content_rank", ((F.col("n") + 1) / F.lit(2.0)).alias("random_rank"), F.col("n").alias("n_models"))


def _mean_rank(c: str, within: str) -> str:
    return f"rank() OVER (PARTITION BY {within} ORDER BY {c}) + (count(*) OVER (PARTITION BY {within}, {c}) - 1) / 2.0::DOUBLE"


@query("WITH RECURSIVE {scores}, " + INVERSIONS + ", " + CAP + ", duo AS (SELECT 1 AS one, model AS item, speaker AS x, content AS y FROM cap), " + tau_sql("duo", "one") + f""",
rk AS (SELECT {_mean_rank("speaker", "1")} AS rx, {_mean_rank("content", "1")} AS ry FROM cap), rho AS (SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM rk),
""" + stats.draws_sql("cap", "family", FAMILY_DRAWS, 23, "blocks").replace("{", "{{").replace("}", "}}") + f""", copies AS (SELECT draw, speaker, content, unnest(range(times)) AS copy FROM cap JOIN draws USING (family)),
cr AS (SELECT draw, {_mean_rank("speaker", "draw")} AS rx, {_mean_rank("content", "draw")} AS ry FROM copies), bs AS (SELECT draw, round(corr(rx, ry), 9) AS b, count(*) AS k FROM cr GROUP BY 1)
SELECT rho.n, rho, {stats.spearman_p_sql("rho", "rho.n")} AS rho_p, round(tau, 6) AS tau, round(CASE WHEN exact THEN px ELSE {stats.two_sided_sql("z")} END, 6) AS tau_p, (SELECT count(DISTINCT family) FROM cap) AS n_families,
(SELECT round(quantile_cont(b, 0.025), 6) FROM bs WHERE k >= 3 AND NOT isnan(b)) AS lo, (SELECT round(quantile_cont(b, 0.975), 6) FROM bs WHERE k >= 3 AND NOT isnan(b)) AS hi FROM rho, tau""")
def qry23_rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    """How far the rankings by two capabilities agree: both rank correlations with their p, and an interval over samples of whole families (QRY23 Y4)."""
    cap = _cap(spark, d)
    rho = stats.spearman(cap, [], "speaker", "content").select("n", r6("rho").alias("rho")).withColumn("rho_p", r6(stats.spearman_p(F.col("rho"), F.col("n"))))
    tau = ranks.kendalls(cap.withColumn("one", F.lit(1)), ["one"], "speaker", "content").select(r6("tau").alias("tau"), r6("p").alias("tau_p"))
    drawn = stats.draws(cap, "family", FAMILY_DRAWS, 23, "blocks").join(cap, "family").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    bs = stats.spearman(drawn, ["draw"], "speaker", "content").where("rho IS NOT NULL").withColumn("rho", F.round("rho", 9))
    iv = stats.interval(bs, [], "rho").select(r6("lo").alias("lo"), r6("hi").alias("hi"))
    return rho.crossJoin(tau).crossJoin(cap.agg(F.countDistinct("family").alias("n_families"))).crossJoin(iv)
