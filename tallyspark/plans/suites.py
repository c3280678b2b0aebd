"""Composite analyses: intervals of correlations, family-blocked suite, transfer between benchmarks, cluster tables, controlled matching, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.keyed import keyed, keyed_sql
from ..operators import ranking, stats
from ..session import table
from .base import manifest, mean6, mean6_sql, query, r6, scores, sparse, vectors
from .inference import mean_rank
from .leaderboards import N_FAMILY_DRAWS, PAIRS, _pair_rho, _task_pairs

#: Resamples of models for each pair of tasks, and for one correlation.
PAIR_DRAWS, DRAWS = 200, 10_000


def _escaped(sql: str) -> str:
    return sql.replace("{", "{{").replace("}", "}}")


# intervals of pair correlations (BOO02)

PAIR_INTERVALS = PAIRS + ", " + _escaped(stats.draws_sql("scores", "model", PAIR_DRAWS, 11, "models")) + f""",
copies AS (SELECT draw, task_a, task_b, x, y, unnest(range(times)) AS copy FROM duo JOIN draws USING (model)),
rd AS (SELECT draw, task_a, task_b, {mean_rank("x", "draw, task_a, task_b")} AS rx, {mean_rank("y", "draw, task_a, task_b")} AS ry FROM copies),
each AS (SELECT draw, task_a, task_b, corr(rx, ry) AS rho FROM rd GROUP BY ALL),
iv AS (SELECT task_a, task_b, round(quantile_cont(rho, 0.025), 6) AS lo, round(quantile_cont(rho, 0.975), 6) AS hi FROM each GROUP BY ALL)"""


def _copied(rows: DataFrame, draws: DataFrame, unit: str) -> DataFrame:
    return rows.join(draws, unit).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))


def pair_intervals(s: DataFrame, n: int = PAIR_DRAWS) -> DataFrame:
    """task_a, task_b, lo, hi: each pair's rank correlation over ``n`` samples of models, ranked anew in each (BOO02)."""
    drawn = _copied(_task_pairs(s), stats.draws(s, "model", n, 11, "models"), "model")
    each = stats.spearman(drawn, ["draw", "task_a", "task_b"], "x", "y")
    return stats.interval(each, ["task_a", "task_b"], "rho").select("task_a", "task_b", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(PAIR_INTERVALS + " SELECT task_a, task_b, rho, lo, hi, ca = cb AS same_type FROM rho JOIN iv USING (task_a, task_b)")
def qry07_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Redundancy of tasks with an interval for each pair (QRY07, BOO02)."""
    s = scores(spark, d)
    return _pair_rho(s).join(pair_intervals(s), ["task_a", "task_b"]).select("task_a", "task_b", "rho", "lo", "hi", (F.col("ca") == F.col("cb")).alias("same_type"))


@query(PAIR_INTERVALS + ", t AS (SELECT DISTINCT task, corpus FROM scores) SELECT task_a, task_b, rho, lo, hi, lo > 0 AS holds FROM rho JOIN iv USING (task_a, task_b) JOIN t a ON a.task = task_a JOIN t b ON b.task = task_b WHERE ca = cb AND a.corpus <> b.corpus")
def qry14_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one capability from two corpora with their intervals (QRY14, BOO02)."""
    s = scores(spark, d)
    of = s.select("task", "corpus").distinct()
    rows = _pair_rho(s).where("ca = cb").join(of.toDF("task_a", "corpus_a"), "task_a").join(of.toDF("task_b", "corpus_b"), "task_b").where("corpus_a <> corpus_b")
    return rows.join(pair_intervals(s), ["task_a", "task_b"]).select("task_a", "task_b", "rho", "lo", "hi", (F.col("lo") > 0).alias("holds"))


TWO_MEANS = "WITH {scores}, m AS (SELECT model, family, " + mean6_sql("capability = 'speaker'") + " AS x, " + mean6_sql("capability = 'content'") + " AS y FROM scores GROUP BY 1, 2)"


def _two_means(s: DataFrame) -> DataFrame:
    return s.groupBy("model", "family").agg(mean6(F.col("capability") == "speaker").alias("x"), mean6(F.col("capability") == "content").alias("y"))


@query(TWO_MEANS + ", " + _escaped(stats.draws_sql("m", "model", DRAWS, 12, "models")) + f""", copies AS (SELECT draw, x, y, unnest(range(times)) AS copy FROM m JOIN draws USING (model)),
rd AS (SELECT draw, {mean_rank("x", "draw")} AS rx, {mean_rank("y", "draw")} AS ry FROM copies), each AS (SELECT draw, corr(rx, ry) AS rho FROM rd GROUP BY 1),
whole AS (SELECT corr(rx, ry) AS rho FROM (SELECT {mean_rank("x")} AS rx, {mean_rank("y")} AS ry FROM m))
SELECT (SELECT count(*) FROM m) AS n, (SELECT round(rho, 6) FROM whole) AS rho, round(quantile_cont(rho, 0.025), 6) AS lo, round(quantile_cont(rho, 0.975), 6) AS hi FROM each""")
def qry13_interval(spark: SparkSession, d: str) -> DataFrame:
    """Whether speaker and content scores trade off, with an interval over models (QRY13, BOO02)."""
    m = _two_means(scores(spark, d))
    each = stats.spearman(_copied(m, stats.draws(m, "model", DRAWS, 12, "models"), "model"), ["draw"], "x", "y")
    return stats.spearman(m, [], "x", "y").crossJoin(stats.interval(each, [], "rho")).select("n", r6("rho").alias("rho"), r6("lo").alias("lo"), r6("hi").alias("hi"))


# the family-blocked suite (QRY22): few families give few different draws, so each is worked out once

FAMILY_DRAWS = PAIRS + ", " + _escaped(stats.draws_sql("scores", "family", N_FAMILY_DRAWS, 7, "families")) + f""",
sig AS (SELECT draw, string_agg(family || ':' || times, '|' ORDER BY family) AS s FROM draws GROUP BY 1), one AS (SELECT s, min(draw) AS draw FROM sig GROUP BY 1),
fam AS (SELECT DISTINCT model, family FROM scores), big AS (SELECT s, task_a, task_b, ca, cb, x, y, unnest(range(times)) AS copy FROM one JOIN draws USING (draw) JOIN fam USING (family) JOIN duo USING (model)),
rb AS (SELECT s, task_a, task_b, ca, cb, {mean_rank("x", "s, task_a, task_b")} AS rx, {mean_rank("y", "s, task_a, task_b")} AS ry FROM big),
rh AS (SELECT s, task_a, task_b, ca, cb, round(corr(rx, ry), 6) AS rho FROM rb GROUP BY ALL),
sep AS (SELECT s, median(rho) FILTER (WHERE ca = cb) - median(rho) FILTER (WHERE ca <> cb) AS sep FROM rh GROUP BY 1)"""


def separation(rho: DataFrame, within: Sequence[str]) -> DataFrame:
    """``within``, sep: the median correlation of task pairs of one capability less that of two (BOO09)."""
    same = F.col("ca") == F.col("cb")
    return rho.groupBy(*within).agg((F.percentile(F.when(same, F.col("rho")), 0.5) - F.percentile(F.when(~same, F.col("rho")), 0.5)).alias("sep"))


def _by_family(s: DataFrame, n: int = N_FAMILY_DRAWS) -> tuple[DataFrame, DataFrame]:
    """(draw, s) and (s, task_a, task_b, ca, cb, rho): s names the multiset of families of a draw."""
    draws = stats.draws(s, "family", n, 7, "families")
    sig = draws.groupBy("draw").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("family", "times"))), lambda x: F.concat(x["family"], F.lit(":"), x["times"].cast("string"))), "|").alias("s"))
    one = sig.groupBy("s").agg(F.min("draw").alias("draw")).join(draws, "draw").select("s", "family", "times")
    of = one.join(s.select("model", "family").distinct(), "family").select("s", "model", "times")
    rho = stats.spearman(_copied(_task_pairs(s), of, "model"), ["s", "task_a", "task_b", "ca", "cb"], "x", "y")
    return sig, rho.withColumn("rho", r6("rho"))


@query(FAMILY_DRAWS + ", seen AS (SELECT median(rho) FILTER (WHERE ca = cb) - median(rho) FILTER (WHERE ca <> cb) AS sep FROM rho) SELECT count(*) AS n_draws, (SELECT round(sep, 6) FROM seen) AS separation, round(quantile_cont(sep, 0.025), 6) AS lo, round(quantile_cont(sep, 0.975), 6) AS hi, round(avg((sep < 0)::INT), 6) AS below, quantile_cont(sep, 0.025) > 0 AS survives FROM sig JOIN sep USING (s)")
def qry22_separation(spark: SparkSession, d: str) -> DataFrame:
    """Whether tasks of one capability agree more than others, over samples of whole families (QRY22 X2, BOO05, BOO09)."""
    s = scores(spark, d)
    sig, rho = _by_family(s)
    each = sig.join(separation(rho, ["s"]), "s")
    row = each.agg(F.count("*").alias("n_draws"), F.percentile("sep", 0.025).alias("lo"), F.percentile("sep", 0.975).alias("hi"), r6(F.avg((F.col("sep") < 0).cast("int"))).alias("below"))
    seen = separation(_pair_rho(s), []).select(r6("sep").alias("separation"))
    return row.crossJoin(seen).select("n_draws", "separation", r6("lo").alias("lo"), r6("hi").alias("hi"), "below", (F.col("lo") > 0).alias("survives"))


@query(FAMILY_DRAWS + ", iv AS (SELECT task_a, task_b, round(quantile_cont(rho, 0.025), 9) AS lo, round(quantile_cont(rho, 0.975), 9) AS hi FROM sig JOIN rh USING (s) GROUP BY 1, 2) SELECT task_a, task_b, rho.rho, lo, hi, lo > 0 AS holds FROM rho JOIN iv USING (task_a, task_b)")
def qry22_pair_intervals(spark: SparkSession, d: str) -> DataFrame:
    """An interval of each pair's correlation over samples of whole families (QRY22 X1)."""
    s = scores(spark, d)
    sig, rho = _by_family(s)
    iv = stats.interval(sig.join(rho, "s"), ["task_a", "task_b"], "rho").select("task_a", "task_b", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))
    return _pair_rho(s).select("task_a", "task_b", "rho").join(iv, ["task_a", "task_b"]).withColumn("holds", F.col("lo") > 0)


@query("WITH {scores}, {pairs}, f AS (SELECT DISTINCT family AS left_out FROM scores), fam AS (SELECT DISTINCT model, family FROM scores), l AS (SELECT left_out, duo.* FROM duo JOIN fam USING (model) JOIN f ON family <> left_out), " + f"""
rk AS (SELECT left_out, task_a, task_b, ca, cb, {mean_rank("x", "left_out, task_a, task_b")} AS rx, {mean_rank("y", "left_out, task_a, task_b")} AS ry FROM l), rho AS (SELECT left_out, task_a, task_b, ca, cb, round(corr(rx, ry), 6) AS rho FROM rk GROUP BY ALL)
SELECT left_out, count(*) AS n_pairs, round(median(rho) FILTER (WHERE ca = cb) - median(rho) FILTER (WHERE ca <> cb), 6) AS separation FROM rho GROUP BY 1""")
def qry22_leave_one_family_out(spark: SparkSession, d: str) -> DataFrame:
    """The separation without each family (QRY22 X4, BOO10)."""
    s = scores(spark, d)
    of = s.select("model", "family").distinct()
    left = of.join(of.select(F.col("family").alias("left_out")).distinct(), F.col("family") != F.col("left_out")).select("model", "left_out")
    rho = stats.spearman(_task_pairs(s).join(left, "model"), ["left_out", "task_a", "task_b", "ca", "cb"], "x", "y").withColumn("rho", r6("rho"))
    n = rho.groupBy("left_out").agg(F.count("*").alias("n_pairs"))
    return separation(rho, ["left_out"]).join(n, "left_out").select("left_out", "n_pairs", r6("sep").alias("separation"))


@query(FAMILY_DRAWS + ", " + _escaped(stats.draws_sql("scores", "model", PAIR_DRAWS, 11, "models")).replace("numbered", "num2").replace("picks", "pick2").replace("draws AS", "draw2 AS") + f""",
c2 AS (SELECT draw, task_a, task_b, x, y, unnest(range(times)) AS copy FROM duo JOIN draw2 USING (model)), r2 AS (SELECT draw, task_a, task_b, {mean_rank("x", "draw, task_a, task_b")} AS rx, {mean_rank("y", "draw, task_a, task_b")} AS ry FROM c2),
e2 AS (SELECT draw, task_a, task_b, corr(rx, ry) AS rho FROM r2 GROUP BY ALL), old AS (SELECT task_a, task_b, round(quantile_cont(rho, 0.975) - quantile_cont(rho, 0.025), 9) AS by_model FROM e2 GROUP BY ALL),
new AS (SELECT task_a, task_b, round(quantile_cont(rho, 0.975) - quantile_cont(rho, 0.025), 9) AS by_family FROM sig JOIN rh USING (s) GROUP BY ALL)
SELECT task_a, task_b, by_model, by_family, by_family > by_model AS wider FROM old JOIN new USING (task_a, task_b)""")
def qry22_widening(spark: SparkSession, d: str) -> DataFrame:
    """Widths of the intervals over models and over families, side by side (QRY22 X3, BOO11, JOI04)."""
    s = scores(spark, d)
    drawn = _copied(_task_pairs(s), stats.draws(s, "model", PAIR_DRAWS, 11, "models"), "model")
    sig, rho = _by_family(s)
    width = lambda rows, name: stats.interval(rows, ["task_a", "task_b"], "rho").select("task_a", "task_b", F.round(F.col("hi") - F.col("lo"), 9).alias(name))
    both = width(stats.spearman(drawn, ["draw", "task_a", "task_b"], "x", "y"), "by_model").join(width(sig.join(rho, "s"), "by_family"), ["task_a", "task_b"])
    return both.withColumn("wider", F.col("by_family") > F.col("by_model"))


# transfer between benchmarks (QRY19-21, QRY26)

COMPLETE = "WITH {scores}, {sparse}, full_tasks AS (SELECT task FROM sparse GROUP BY 1 HAVING count(score) = (SELECT count(DISTINCT model) FROM scores)), c AS (SELECT s.* FROM sparse s SEMI JOIN full_tasks USING (task))"


def _complete(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the tasks that every model has (FLT07)."""
    s = sparse(spark, d)
    n = s.agg(F.countDistinct("model").alias("n_models"))
    whole = s.groupBy("task").agg(F.count("score").alias("n")).join(F.broadcast(n), F.col("n") == F.col("n_models")).select("task")
    return s.join(whole, "task", "left_semi")


@query(COMPLETE + ", m AS (SELECT model, k.capability, " + mean6_sql("c.capability = k.capability") + " AS own, " + mean6_sql("c.capability <> k.capability") + f""" AS others FROM c CROSS JOIN (SELECT DISTINCT capability FROM c) k GROUP BY 1, 2),
r AS (SELECT capability, {mean_rank("own", "capability")} AS ro, {mean_rank("others", "capability")} AS rt FROM m)
SELECT capability, count(*) AS n, round(corr(ro, rt), 6) AS rho, round(corr(ro, rt) - max(corr(ro, rt)) OVER (), 6) AS below_best FROM r GROUP BY 1""")
def qry19_capability_transfer(spark: SparkSession, d: str) -> DataFrame:
    """How far a capability's mean, over complete tasks, orders models as the other capabilities do, and its difference to the best (QRY19)."""
    c = _complete(spark, d)
    every = c.withColumnRenamed("capability", "of").crossJoin(F.broadcast(c.select("capability").distinct()))
    m = every.groupBy("model", "capability").agg(mean6(F.col("of") == F.col("capability")).alias("own"), mean6(F.col("of") != F.col("capability")).alias("others"))
    rho = stats.spearman(m, ["capability"], "own", "others")
    best = rho.agg(F.max("rho").alias("best"))
    return rho.crossJoin(F.broadcast(best)).select("capability", "n", r6("rho").alias("rho"), r6(F.col("rho") - F.col("best")).alias("below_best"))


@query(COMPLETE + ", g AS (SELECT model, " + mean6_sql() + " AS s FROM c GROUP BY 1), l AS (SELECT corpus, model, " + mean6_sql() + f""" AS t FROM c GROUP BY 1, 2),
b AS (SELECT corpus, model, s, t, rank() OVER (PARTITION BY corpus ORDER BY s DESC) AS general, rank() OVER (PARTITION BY corpus ORDER BY t DESC) AS local FROM l JOIN g USING (model)),
r AS (SELECT corpus, {mean_rank("s", "corpus")} AS rs, {mean_rank("t", "corpus")} AS rt FROM b), q AS (SELECT corpus, round(corr(rs, rt), 6) AS rho FROM r GROUP BY 1)
SELECT corpus, model, general::BIGINT AS general, local::BIGINT AS local, (general - local)::BIGINT AS shift, rho FROM b JOIN q USING (corpus)""")
def qry20_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """Ranks over all complete tasks and within each corpus, with their correlation (QRY20)."""
    c = _complete(spark, d)
    b = c.groupBy("corpus", "model").agg(mean6().alias("t")).join(c.groupBy("model").agg(mean6().alias("s")), "model")
    place = lambda x: F.rank().over(Window.partitionBy("corpus").orderBy(F.desc(x))).cast("long")
    q = stats.spearman(b, ["corpus"], "s", "t").select("corpus", r6("rho").alias("rho"))
    return b.select("corpus", "model", place("s").alias("general"), place("t").alias("local")).withColumn("shift", F.col("general") - F.col("local")).join(q, "corpus")


COVERED = "WITH {scores}, {sparse}, a AS (SELECT model, count(score) AS here FROM sparse WHERE capability <> 'content' GROUP BY 1), b AS (SELECT model, count(score) AS there FROM sparse WHERE capability = 'content' AND model <> 'NATION_3' GROUP BY 1), status AS (SELECT model, coalesce(here, 0) AS here, coalesce(there, 0) AS there, coalesce(here, 0) >= 15 AND coalesce(there, 0) >= 8 AS eligible FROM a FULL JOIN b USING (model))"


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    s = sparse(spark, d)
    here = s.where("capability <> 'content'").groupBy("model").agg(F.count("score").alias("here"))
    there = s.where("capability = 'content' AND model <> 'NATION_3'").groupBy("model").agg(F.count("score").alias("there"))
    both = here.join(there, "model", "full").select("model", F.coalesce("here", F.lit(0)).alias("here"), F.coalesce("there", F.lit(0)).alias("there"))
    return both.withColumn("eligible", (F.col("here") >= 15) & (F.col("there") >= 8))


@query(COVERED + " SELECT * FROM status")
def qry21_status(spark: SparkSession, d: str) -> DataFrame:
    """Cells that each model has in two benchmarks, and whether they are enough (QRY21, JOI12, FLT08)."""
    return _coverage(spark, d)


@query(COVERED + ", e AS (SELECT s.* FROM sparse s JOIN status USING (model) WHERE eligible), m AS (SELECT model, " + mean6_sql("capability <> 'content' AND score IS NOT NULL") + " AS x, " + mean6_sql("capability = 'content' AND score IS NOT NULL") + f""" AS y FROM e GROUP BY 1), r AS (SELECT {mean_rank("x")} AS rx, {mean_rank("y")} AS ry FROM m),
t AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt((sum(sign(a.x - b.x) * sign(a.x - b.x)) * sum(sign(a.y - b.y) * sign(a.y - b.y)))::DOUBLE) AS tau FROM m a JOIN m b ON a.model < b.model)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho, (SELECT round(tau, 6) FROM t) AS tau FROM r""")
def qry21_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Whether one benchmark orders the eligible models as the other does (QRY21)."""
    e = sparse(spark, d).join(_coverage(spark, d).where("eligible").select("model"), "model", "left_semi")
    there = (F.col("capability") == "content") & F.col("score").isNotNull()
    m = e.groupBy("model").agg(mean6((F.col("capability") != "content") & F.col("score").isNotNull()).alias("x"), mean6(there).alias("y"))
    return stats.spearman(m, [], "x", "y").crossJoin(stats.kendall(m, [], "model", "x", "y")).select("n", r6("rho").alias("rho"), r6("tau").alias("tau"))


@query("""WITH j AS (SELECT user_id AS model, event_type AS task, event_id, map_from_entries([('accuracy', value), ('f1', round(value * (1 - (event_id % 3) / 10.0::DOUBLE), 4)), ('ap', CASE WHEN event_id % 4 = 0 THEN value ELSE 0 END)]) AS e FROM events),
k AS (SELECT *, CASE task WHEN 'view' THEN 'ap' WHEN 'click' THEN 'f1' ELSE 'accuracy' END AS declared FROM j), last AS (SELECT model, task, arg_max(e, event_id) AS e, any_value(declared) AS declared FROM k GROUP BY 1, 2)
SELECT model, task, declared, e[declared] AS main_score, array_to_string(list_sort(list_filter(map_keys(e), lambda x: e[x] = e[declared])), '|') AS equal_keys FROM last""")
def src14_declared_metric(spark: SparkSession, d: str) -> DataFrame:
    """The declared metric of each cell's last result, and all the keys that have its value (SRC14, QRY26)."""
    value, i = F.col("value"), F.col("event_id")
    e = F.create_map(F.lit("accuracy"), value, F.lit("f1"), F.round(value * (1 - (i % 3) / 10.0), 4), F.lit("ap"), F.when(i % 4 == 0, value).otherwise(0.0))
    declared = F.when(F.col("event_type") == "view", "ap").when(F.col("event_type") == "click", "f1").otherwise("accuracy")
    last = table(spark, d, "events").select(F.col("user_id").alias("model"), F.col("event_type").alias("task"), "event_id", e.alias("e"), declared.alias("declared")).groupBy("model", "task").agg(F.max_by("e", "event_id").alias("e"), F.max("declared").alias("declared"))
    main = F.element_at("e", F.col("declared"))
    return last.select("model", "task", "declared", main.alias("main_score"), F.array_join(F.sort_array(F.map_keys(F.map_filter("e", lambda k, v: v == main))), "|").alias("equal_keys"))


@query("""WITH k AS (SELECT user_id AS model, event_type AS task, arg_max(value, event_id) AS s FROM events GROUP BY 1, 2), n AS (SELECT count(DISTINCT model)::DOUBLE AS n FROM k),
r AS (SELECT model, task, s, rank() OVER (PARTITION BY task ORDER BY s DESC) + (count(*) OVER (PARTITION BY task, s) - 1) / 2.0::DOUBLE AS r FROM k) SELECT model, count(*) AS n_tasks, sum(n - r) AS points, rank() OVER (ORDER BY sum(n - r) DESC)::BIGINT AS rank, round(sum(round(s * 100)::BIGINT) / count(*)::DOUBLE, 9) AS mean_score FROM r, n GROUP BY 1""")
def qry26_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """A leaderboard rebuilt from raw results: the last result of each cell, then points and means (QRY26)."""
    k = table(spark, d, "events").groupBy(F.col("user_id").alias("model"), F.col("event_type").alias("task")).agg(F.max_by("value", "event_id").alias("score"))
    means = k.groupBy("model").agg(F.count("*").alias("n_tasks"), F.round(F.sum(F.round(F.col("score") * 100).cast("long")) / F.count("*").cast("double"), 9).alias("mean_score"))
    return ranking.borda(k).join(means, "model").select("model", "n_tasks", "points", "rank", "mean_score")


# cluster structure of vectors (QRY27, QRY28)

CLUSTERS = """WITH {vectors}, x AS (SELECT id, label, unnest(vec) AS v, generate_subscripts(vec, 1) AS p FROM vectors), n AS (SELECT label, count(*) AS n FROM vectors GROUP BY 1),
c AS (SELECT label, p, avg(v) AS c FROM x GROUP BY 1, 2), mu AS (SELECT p, avg(v) AS m FROM x GROUP BY 1)"""


def _coordinates(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    x = v.select("id", "label", F.posexplode("vec").alias("p", "v"))
    return x, x.groupBy("label", "p").agg(F.avg("v").alias("c"))


@query(CLUSTERS + """, b AS (SELECT sum(n * (c - m) * (c - m)) AS b FROM c JOIN mu USING (p) JOIN n USING (label)), w AS (SELECT sum((v - c) * (v - c)) AS w FROM x JOIN c USING (label, p)),
k AS (SELECT count(*) AS n_clusters, sum(n)::BIGINT AS n_rows FROM n) SELECT n_clusters, n_rows, round(b / (n_clusters - 1) / (w / (n_rows - n_clusters)), 6) AS calinski_harabasz FROM b, w, k""")
def clu09_calinski_harabasz(spark: SparkSession, d: str) -> DataFrame:
    """Spread between the labels' centres to that within (CLU09), from sums, without a pair of rows."""
    v = vectors(spark, d)
    x, c = _coordinates(v)
    n = v.groupBy("label").agg(F.count("*").alias("n"))
    mu = x.groupBy("p").agg(F.avg("v").alias("m"))
    b = c.join(F.broadcast(mu), "p").join(n, "label").agg(F.sum(F.col("n") * (F.col("c") - F.col("m")) * (F.col("c") - F.col("m"))).alias("b"))
    w = x.join(c, ["label", "p"]).agg(F.sum((F.col("v") - F.col("c")) * (F.col("v") - F.col("c"))).alias("w"))
    size = n.agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_rows"))
    return size.crossJoin(b).crossJoin(w).select("n_clusters", "n_rows", r6(F.col("b") / (F.col("n_clusters") - 1) / (F.col("w") / (F.col("n_rows") - F.col("n_clusters")))).alias("calinski_harabasz"))


@query(CLUSTERS + """, q AS (SELECT id, label, sqrt(sum((v - c) * (v - c))) AS far FROM x JOIN c USING (label, p) GROUP BY 1, 2), s AS (SELECT label, avg(far) AS s FROM q GROUP BY 1),
m AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m FROM c a JOIN c b ON a.p = b.p AND a.label <> b.label GROUP BY 1, 2), r AS (SELECT i, max((a.s + b.s) / m) AS worst FROM m JOIN s a ON a.label = i JOIN s b ON b.label = j GROUP BY 1)
SELECT count(*) AS n_clusters, round(avg(worst), 6) AS davies_bouldin FROM r""")
def clu08_davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    """Mean over labels of the worst ratio of their spread to their distance (CLU08); pairs are of labels, not of rows."""
    x, c = _coordinates(vectors(spark, d))
    far = x.join(c, ["label", "p"]).groupBy("id", "label").agg(F.sqrt(F.sum((F.col("v") - F.col("c")) * (F.col("v") - F.col("c")))).alias("far")).groupBy("label").agg(F.avg("far").alias("s"))
    apart = c.toDF("i", "p", "a").join(c.toDF("j", "p", "b"), "p").where("i <> j").groupBy("i", "j").agg(F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("m"))
    worst = apart.join(far.toDF("i", "si"), "i").join(far.toDF("j", "sj"), "j").groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.col("m")).alias("worst"))
    return worst.agg(F.count("*").alias("n_clusters"), r6(F.avg("worst")).alias("davies_bouldin"))


DEALT = "WITH e AS (SELECT vec_id, label, " + keyed_sql(31, "cluster", "vec_id") + " % 10 AS dealt FROM embeddings), h AS (SELECT vec_id, label, " + keyed_sql(31, "permute", "vec_id") + " AS h, (SELECT 1 + count(*) // 100000 FROM e) AS parts FROM e), o AS (SELECT label, h % parts AS part, row_number() OVER (PARTITION BY h % parts ORDER BY vec_id) AS slot FROM h), q AS (SELECT label, h % parts AS part, row_number() OVER (PARTITION BY h % parts ORDER BY h, vec_id) AS slot FROM h)"


@query(DEALT + ", c AS (SELECT label, dealt, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT dealt, max(n) AS top FROM c GROUP BY 1), m AS (SELECT label, count(*) AS n FROM e GROUP BY 1) SELECT round((SELECT sum(top) FROM t) / count(*)::DOUBLE, 6) AS random_purity, round((SELECT avg((o.label = q.label)::INT) FROM o JOIN q USING (part, slot)), 6) AS permuted_match, round((SELECT max(n) FROM m) / count(*)::DOUBLE, 6) AS majority FROM e")
def clu11_baselines(spark: SparkSession, d: str) -> DataFrame:
    """What a random partition and a permutation of the labels reach (CLU11). Labels are permuted inside parts of about 100,000 rows, drawn by a keyed hash, so no task orders more than that."""
    e = table(spark, d, "embeddings").select("vec_id", "label", (keyed(31, "cluster", "vec_id") % 10).alias("dealt"))
    top = e.groupBy("label", "dealt").agg(F.count("*").alias("n")).groupBy("dealt").agg(F.max("n").alias("top")).agg(F.sum("top").alias("tops"))
    parts = e.agg((1 + F.floor(F.count("*") / 100_000)).alias("parts"))
    h = e.withColumn("h", keyed(31, "permute", "vec_id")).crossJoin(F.broadcast(parts)).withColumn("part", F.col("h") % F.col("parts"))
    place = lambda *by: F.row_number().over(Window.partitionBy("part").orderBy(*by))
    match = h.select("part", F.col("label").alias("a"), place("vec_id").alias("slot")).join(h.select("part", F.col("label").alias("b"), place("h", "vec_id").alias("slot")), ["part", "slot"])
    match = match.agg(r6(F.avg((F.col("a") == F.col("b")).cast("int"))).alias("permuted_match"))
    size = e.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return size.crossJoin(top).crossJoin(match).select(r6(F.col("tops") / F.col("all").cast("double")).alias("random_purity"), "permuted_match", r6(F.col("most") / F.col("all").cast("double")).alias("majority"))


@query("WITH {manifest}, c AS (SELECT dataset AS prompt, speaker_id, count(*) AS n FROM manifest GROUP BY ALL), s AS (SELECT speaker_id, sum(n) AS all_, max(n) AS most, count(*) AS kinds FROM c GROUP BY 1) SELECT kinds AS prompts_per_speaker, count(*) AS n_speakers, round(avg(most / all_::DOUBLE), 6) AS share_of_commonest FROM s GROUP BY 1")
def clu14_confound(spark: SparkSession, d: str) -> DataFrame:
    """How far speakers and prompts go together (CLU14)."""
    s = manifest(spark, d).groupBy("dataset", "speaker_id").agg(F.count("*").alias("n")).groupBy("speaker_id").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.count("*").alias("prompts_per_speaker"))
    return s.groupBy("prompts_per_speaker").agg(F.count("*").alias("n_speakers"), r6(F.avg(F.col("most") / F.col("all").cast("double"))).alias("share_of_commonest"))


# retrieval metrics at several cuts (MET04-06, MET08, MET12)


@query("WITH {vectors}, n AS (SELECT label, count(*) - 1 AS npos, (SELECT count(*) - 1 FROM vectors) AS ncand FROM vectors GROUP BY 1), q AS (SELECT npos, ncand FROM vectors JOIN n USING (label) WHERE npos > 0) SELECT count(*) AS n_queries, round(sum(npos) / sum(ncand)::DOUBLE, 6) AS random_map FROM q")
def met04_random_baseline(spark: SparkSession, d: str) -> DataFrame:
    """What a random ranking reaches: relevant rows over candidates (MET04), from counts by label."""
    n = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("all"))
    row = n.where("n > 1").crossJoin(F.broadcast(whole)).agg(F.sum("n").alias("n_queries"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pos"), F.sum(F.col("n") * (F.col("all") - 1)).alias("cand"))
    return row.select("n_queries", r6(F.col("pos") / F.col("cand").cast("double")).alias("random_map"))


# audits of vectors (QRY41, VEC14)


@query("""WITH {vectors}, s AS (SELECT avg(list_inner_product(a.vec, b.vec)) AS c FROM vectors a JOIN vectors b ON a.id < b.id), v AS (SELECT stddev_pop(x) AS sd FROM (SELECT unnest(e) AS x FROM raw)), r AS (SELECT count(DISTINCT list_transform(e, lambda x: round(x, 4))) AS n_distinct, count(*) AS n FROM raw)
SELECT n, n_distinct, round(sd, 6) AS sd, round(c, 6) AS mean_cos, c > 0.999 OR sd < 1e-6 OR n_distinct < n / 2 AS degenerate FROM s, v, r""")
def qry41_load_audit(spark: SparkSession, d: str) -> DataFrame:
    """Whether vectors have collapsed: mean cosine from the sum vector, deviation, distinct rows (QRY41, VEC14)."""
    e = table(spark, d, "embeddings").select(V.doubles(F.col("embedding")).alias("e"))
    x = e.select(F.posexplode(V.unit(F.col("e"))).alias("p", "v")).groupBy("p").agg(F.sum("v").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("whole"))
    sd = e.select(F.explode("e").alias("x")).agg(F.stddev_pop("x").alias("sd"))
    n = e.agg(F.count("*").alias("n"), F.countDistinct(F.transform("e", lambda v: F.round(v, 4))).alias("n_distinct"))
    cos = (F.col("whole") - F.col("n")) / (F.col("n") * (F.col("n") - 1.0))
    return n.crossJoin(sd).crossJoin(x).select("n", "n_distinct", r6("sd").alias("sd"), r6(cos).alias("mean_cos"), ((cos > 0.999) | (F.col("sd") < 1e-6) | (F.col("n_distinct") < F.col("n") / 2)).alias("degenerate"))


@query("WITH f AS (SELECT vec_id, unnest(e) AS v, generate_subscripts(e, 1) AS frame FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)) SELECT vec_id, round(avg(v) FILTER (WHERE frame <= 10 + vec_id % 20), 6) AS pooled, count(*) FILTER (WHERE frame <= 10 + vec_id % 20) AS n_valid FROM f GROUP BY 1")
def vec06_masked_mean(spark: SparkSession, d: str) -> DataFrame:
    """Means over valid frames only (VEC06)."""
    valid = F.slice(V.doubles(F.col("embedding")), 1, (10 + F.col("vec_id") % 20).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", r6(V.total(valid) / F.size(valid)).alias("pooled"), F.size(valid).cast("long").alias("n_valid"))


# samples (SMP09-13, SMP15, SMP19, SMP20)


@query("WITH {manifest}, c AS (SELECT speaker_id FROM manifest GROUP BY 1 HAVING count(*) >= 10 ORDER BY " + keyed_sql(51, "session", "speaker_id") + ", speaker_id LIMIT 20), k AS (SELECT utt_id, speaker_id, row_number() OVER (PARTITION BY speaker_id ORDER BY " + keyed_sql(13, "cap", "utt_id") + ", utt_id) AS r FROM manifest JOIN c USING (speaker_id)) SELECT utt_id, speaker_id FROM k WHERE r <= 25")
def smp09_sessions(spark: SparkSession, d: str, classes: int = 20, most: int = 25) -> DataFrame:
    """A clustering sample: drawn classes of at least ten rows, rows drawn within each (SMP09, SMP12)."""
    m = manifest(spark, d).select("utt_id", "speaker_id")
    c = m.groupBy("speaker_id").agg(F.count("*").alias("n")).where("n >= 10").orderBy(keyed(51, "session", "speaker_id"), "speaker_id").limit(classes).select("speaker_id")
    r = F.row_number().over(Window.partitionBy("speaker_id").orderBy(keyed(13, "cap", "utt_id"), "utt_id"))
    return m.join(F.broadcast(c), "speaker_id").withColumn("r", r).where(F.col("r") <= most).select("utt_id", "speaker_id")


@query("WITH q AS (SELECT quantile_cont(n_chars::DOUBLE, 1.0::DOUBLE/3) AS lo, quantile_cont(n_chars::DOUBLE, 2.0::DOUBLE/3) AS hi FROM documents), b AS (SELECT doc_id, CASE WHEN n_chars < lo THEN 'low' WHEN n_chars < hi THEN 'medium' ELSE 'high' END AS band FROM documents, q), k AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY " + keyed_sql(52, "tercile", "doc_id") + ", doc_id) AS r FROM b) SELECT doc_id, band, CASE WHEN r <= 20 THEN 'test' ELSE 'train' END AS split FROM k WHERE r <= 100")
def smp10_tercile_balanced(spark: SparkSession, d: str) -> DataFrame:
    """As many rows of each third by length, and a test part of each (SMP10)."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    q = docs.agg(F.percentile("n_chars", 1.0 / 3).alias("lo"), F.percentile("n_chars", 2.0 / 3).alias("hi"))
    band = F.when(F.col("n_chars") < F.col("lo"), "low").when(F.col("n_chars") < F.col("hi"), "medium").otherwise("high")
    k = docs.crossJoin(F.broadcast(q)).select("doc_id", band.alias("band")).withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy(keyed(52, "tercile", "doc_id"), "doc_id")))
    return k.where("r <= 100").select("doc_id", "band", F.when(F.col("r") <= 20, "test").otherwise("train").alias("split"))


@query("WITH {manifest}, g AS (SELECT dataset, count(*) AS n, count(DISTINCT speaker_id) AS speakers FROM manifest GROUP BY 1), t AS (SELECT dataset, norm FROM manifest WHERE length(norm) > 0 GROUP BY 1, 2 HAVING count(DISTINCT speaker_id) >= 2), c AS (SELECT dataset, count(*) AS texts FROM t GROUP BY 1) SELECT dataset, kind, CASE kind WHEN 'speaker' THEN CASE WHEN speakers < 2 THEN 'one speaker' END WHEN 'retrieval' THEN CASE WHEN coalesce(texts, 0) < 10 THEN 'too few shared texts' END ELSE CASE WHEN n < 300 THEN 'too few rows' END END AS skip_reason FROM g LEFT JOIN c USING (dataset) CROSS JOIN (SELECT unnest(['speaker', 'retrieval', 'clustering']) AS kind)")
def smp13_task_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Which tasks each data set can give, and why not (SMP13, QRY29)."""
    m = manifest(spark, d)
    g = m.groupBy("dataset").agg(F.count("*").alias("n"), F.countDistinct("speaker_id").alias("speakers"))
    c = m.where(F.length("norm") > 0).groupBy("dataset", F.md5("norm").alias("k")).agg(F.countDistinct("speaker_id").alias("h")).where("h >= 2").groupBy("dataset").agg(F.count("*").alias("texts"))
    every = g.join(c, "dataset", "left").select("*", F.explode(F.array(*map(F.lit, ("speaker", "retrieval", "clustering")))).alias("kind"))
    why = F.when(F.col("kind") == "speaker", F.when(F.col("speakers") < 2, "one speaker")).when(F.col("kind") == "retrieval", F.when(F.coalesce("texts", F.lit(0)) < 10, "too few shared texts")).otherwise(F.when(F.col("n") < 300, "too few rows"))
    return every.select("dataset", "kind", why.alias("skip_reason"))


FOLDS = ", ".join(f"row_number() OVER (PARTITION BY label ORDER BY {keyed_sql(s, 'fold', 'vec_id')}, vec_id) AS r{s}" for s in range(5))


@query("WITH k AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n, " + FOLDS + " FROM embeddings) SELECT vec_id, " + ", ".join(f"CASE WHEN n < 4 THEN 'excluded' WHEN r{s} <= n // 4 THEN 'test' ELSE 'train' END AS seed{s}" for s in range(5)) + " FROM k")
def smp19_folds(spark: SparkSession, d: str) -> DataFrame:
    """Membership of every row in five stratified splits, side by side (SMP19)."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    w = Window.partitionBy("label")
    k = e.withColumn("n", F.count("*").over(w))
    for s in range(5):
        k = k.withColumn(f"r{s}", F.row_number().over(w.orderBy(keyed(s, "fold", "vec_id"), "vec_id")))
    fold = lambda s: F.when(F.col("n") < 4, "excluded").when(F.col(f"r{s}") <= F.floor(F.col("n") / 4), "test").otherwise("train")
    return k.select("vec_id", *[fold(s).alias(f"seed{s}") for s in range(5)])


@query("WITH {manifest}, n AS (SELECT count(*) AS n FROM manifest), r AS (SELECT i, " + keyed_sql(53, "left", "i") + " % n AS a, " + keyed_sql(53, "right", "i") + " % n AS b FROM (SELECT unnest(range(2000)) AS i), n), o AS (SELECT utt_id, speaker_id, md5(norm) AS t FROM manifest) SELECT i, a, b FROM r JOIN o x ON x.utt_id = a JOIN o y ON y.utt_id = b WHERE a <> b AND x.speaker_id <> y.speaker_id AND x.t <> y.t")
def smp20_random_pairs(spark: SparkSession, d: str, draws: int = 2000) -> DataFrame:
    """Pairs of ids drawn by hash, less those of one speaker or text (SMP20)."""
    o = manifest(spark, d).select("utt_id", "speaker_id", F.md5("norm").alias("t"))
    n = o.agg(F.count("*").alias("n"))
    r = spark.range(draws).withColumnRenamed("id", "i").crossJoin(F.broadcast(n)).select("i", (keyed(53, "left", "i") % F.col("n")).alias("a"), (keyed(53, "right", "i") % F.col("n")).alias("b"))
    both = r.join(o.toDF("a", "sa", "ta"), "a").join(o.toDF("b", "sb", "tb"), "b")
    return both.where("a <> b AND sa <> sb AND ta <> tb").select("i", "a", "b")


# tables and exports (QRY36, QRY44, QRY47, QRY49, SNK02, SNK05, SNK06, SNK10)


@query("WITH {scores}, c AS (SELECT task, u AS control FROM scores WHERE model = 'NATION_0'), m AS (SELECT model, capability, count(*) AS n, sum(s.u)::DOUBLE / sum(control) AS ratio FROM scores s JOIN c USING (task) WHERE model <> 'NATION_0' GROUP BY 1, 2) SELECT capability, count(*) AS n, round(min(ratio), 6) AS least, round(max(ratio), 6) AS most, round(median(ratio), 6) AS median_ratio, count_if(ratio < 1) AS below_control FROM m GROUP BY 1")
def qry36_control_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Each encoder's sum of scores over the control's, by capability (QRY36)."""
    s = scores(spark, d)
    c = s.where("model = 'NATION_0'").select("task", F.col("u").alias("control"))
    m = s.where("model <> 'NATION_0'").join(F.broadcast(c), "task").groupBy("model", "capability").agg((F.sum("u").cast("double") / F.sum("control")).alias("ratio"))
    return m.groupBy("capability").agg(F.count("*").alias("n"), r6(F.min("ratio")).alias("least"), r6(F.max("ratio")).alias("most"), r6(F.percentile("ratio", 0.5)).alias("median_ratio"), F.count_if(F.col("ratio") < 1).alias("below_control"))


@query("WITH {scores} SELECT model, capability, arg_max(task, (u, task)) AS best_task, max(score) AS best, arg_max(u, task) / 1e6::DOUBLE AS last_score FROM scores GROUP BY 1, 2")
def qry44_best_rows(spark: SparkSession, d: str) -> DataFrame:
    """The best entry of each model and capability beside its last one (QRY44, AGG09, WIN13)."""
    return scores(spark, d).groupBy("model", "capability").agg(F.max_by("task", F.struct("u", "task")).alias("best_task"), F.max("score").alias("best"), F.max_by("score", "task").alias("last_score"))


@query("WITH {scores}, m AS (SELECT model, capability, " + mean6_sql() + " AS s FROM scores GROUP BY 1, 2), w AS (SELECT model, " + mean6_sql() + " AS s FROM scores GROUP BY 1) SELECT 'best for ' || capability AS advice, arg_min(model, (-s, model)) AS model, max(s) AS score FROM m GROUP BY capability UNION ALL SELECT 'best overall', arg_min(model, (-s, model)), max(s) FROM w")
def qry47_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """The model to take, overall and for each capability (QRY47)."""
    s = scores(spark, d)
    best = (F.min_by("model", F.struct(F.negative("s").alias("o"), "model")).alias("model"), F.max("s").alias("score"))
    each = s.groupBy("model", "capability").agg(mean6().alias("s")).groupBy("capability").agg(*best).select(F.concat(F.lit("best for "), "capability").alias("advice"), "model", "score")
    return each.unionByName(s.groupBy("model").agg(mean6().alias("s")).agg(*best).select(F.lit("best overall").alias("advice"), "model", "score"))


@query("WITH {scores}, {sparse}, a AS (SELECT model, task, score FROM scores WHERE model <> 'NATION_4'), b AS (SELECT model, task, score FROM sparse WHERE score IS NOT NULL) SELECT model, task, a.score AS before, b.score AS after, round(b.score - a.score, 6) AS delta, CASE WHEN a.model IS NULL THEN 'added' WHEN b.model IS NULL THEN 'removed' ELSE 'both' END AS status FROM a FULL JOIN b USING (model, task)")
def qry49_before_after(spark: SparkSession, d: str) -> DataFrame:
    """Every cell before and after, with a difference only where both are there (QRY49, JOI13)."""
    a = scores(spark, d).where("model <> 'NATION_4'").select("model", "task", F.col("score").alias("before"))
    b = sparse(spark, d).where("score IS NOT NULL").select("model", "task", F.col("score").alias("after"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("both")
    return a.join(b, ["model", "task"], "full").select("model", "task", "before", "after", r6(F.col("after") - F.col("before")).alias("delta"), status.alias("status"))


@query("WITH {scores} SELECT concat_ws(chr(9), model, task, printf('%.6f', score)) AS line FROM scores")
def snk02_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows as lines of a table with six places (SNK02)."""
    return scores(spark, d).select(F.concat_ws("\t", "model", "task", F.format_string("%.6f", "score")).alias("line"))


@query("WITH {scores} SELECT '| ' || model || ' | ' || count(*) || ' | ' || printf('%.6f', max(score)) || ' |' AS line FROM scores GROUP BY model")
def snk06_report_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a text report's table (SNK06)."""
    g = scores(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    return g.select(F.concat(F.lit("| "), "model", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.format_string("%.6f", "best"), F.lit(" |")).alias("line"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents")
def snk10_checksums(spark: SparkSession, d: str) -> DataFrame:
    """A digest and a length of every item of a package (SNK10)."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
