"""Score tables: leaderboards, aggregations, correlations, resampling (families F6 and F7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranking, stats
from .base import CAPABILITIES, mean6, mean6_sql, query, r6, scores

def percent(c: str) -> Column:
    """Times 100, to two places, halves up on the binary value."""
    return F.floor(F.col(c) * 10000 + 0.5) / 100


TASKS = [f"Brand#{i}" for i in range(1, 26)]
#: Resamples of tasks and of families.
N_DRAWS, N_FAMILY_DRAWS = 10_000, 2_000


def _tasks_sql(f: str) -> str:
    return ", ".join(f.format(t=t, c=t.replace("#", "_").lower()) for t in TASKS)


@query("""WITH {scores}, pts AS (SELECT model, sum(n_models - r) AS points, """ + mean6_sql() + """ AS mean_task FROM ranked, nm GROUP BY model),
mt AS (SELECT model, """ + mean6_sql() + """ AS mean_type FROM (SELECT model, capability, round(1e6 * """ + mean6_sql() + """)::BIGINT AS u FROM scores GROUP BY 1, 2) GROUP BY 1)
SELECT model, points, rank() OVER (ORDER BY points DESC)::BIGINT AS rank, mean_task, mean_type FROM pts JOIN mt USING (model)""")
def qry01_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    types = s.groupBy("model", "capability").agg(F.round(1e6 * mean6()).cast("long").alias("u")).groupBy("model").agg(mean6().alias("mean_type"))
    return ranking.borda(s).join(s.groupBy("model").agg(mean6().alias("mean_task")), "model").join(types, "model").select("model", "points", "rank", "mean_task", "mean_type")


@query("WITH {scores} SELECT model, " + _tasks_sql("max(floor(score * 10000 + 0.5) / 100) FILTER (WHERE task = '{t}') AS {c}") + " FROM scores GROUP BY model")
def qry02_per_task(spark: SparkSession, d: str) -> DataFrame:
    wide = scores(spark, d).groupBy("model").pivot("task", TASKS).agg(F.max(percent("score")))
    return wide.select("model", *[F.col(f"`{t}`").alias(t.replace("#", "_").lower()) for t in TASKS])


AGGREGATIONS = """WITH {scores}, b AS (SELECT model, sum(n_models - r) AS borda, avg(r) AS mean_rank, avg(score) AS mean_score FROM ranked, nm GROUP BY 1),
c AS (SELECT model, avg(m) AS capability_rank FROM (SELECT model, capability, avg(r) AS m FROM ranked GROUP BY 1, 2) GROUP BY 1),
agg AS (SELECT model, rank() OVER (ORDER BY borda DESC)::BIGINT AS by_borda, rank() OVER (ORDER BY round(mean_rank, 9))::BIGINT AS by_rank, rank() OVER (ORDER BY round(mean_score, 9) DESC)::BIGINT AS by_score, rank() OVER (ORDER BY round(capability_rank, 9))::BIGINT AS by_capability FROM b JOIN c USING (model))"""


def _aggregations(s: DataFrame) -> DataFrame:
    ranked = s.withColumn("r", ranking.rank_ties(["task"], F.desc("score"), ["score"]))
    balanced = ranked.groupBy("model", "capability").agg(F.avg("r").alias("m")).groupBy("model").agg(F.round(F.avg("m"), 9).alias("capability_rank"))
    means = ranked.groupBy("model").agg(F.round(F.avg("r"), 9).alias("mean_rank"), F.round(F.avg("score"), 9).alias("mean_score"))
    rows = ranking.borda(s).select("model", F.col("rank").alias("by_borda")).join(means, "model").join(balanced, "model")
    place = lambda c: F.rank().over(Window.orderBy(c)).cast("long")
    return rows.select("model", "by_borda", place(F.col("mean_rank")).alias("by_rank"), place(F.desc("mean_score")).alias("by_score"), place(F.col("capability_rank")).alias("by_capability"))


@query(AGGREGATIONS + " SELECT * FROM agg")
def qry03_aggregations(spark: SparkSession, d: str) -> DataFrame:
    return _aggregations(scores(spark, d))


@query(AGGREGATIONS + """, l AS (UNPIVOT agg ON by_borda, by_rank, by_score, by_capability INTO NAME scheme VALUE place),
p AS (SELECT a.scheme AS scheme_a, b.scheme AS scheme_b, a.model, a.place AS x, b.place AS y FROM l a JOIN l b ON a.model = b.model AND a.scheme < b.scheme),
q AS (SELECT a.scheme_a, a.scheme_b, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM p a JOIN p b ON a.scheme_a = b.scheme_a AND a.scheme_b = b.scheme_b AND a.model < b.model)
SELECT scheme_a, scheme_b, round(sum(sx * sy) / sqrt((sum(sx * sx) * sum(sy * sy))::DOUBLE), 6) AS tau FROM q GROUP BY 1, 2""")
def qry03_scheme_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = _aggregations(scores(spark, d)).unpivot("model", ["by_borda", "by_rank", "by_score", "by_capability"], "scheme", "place")
    a, b = rows.toDF("model", "scheme_a", "x"), rows.toDF("model", "scheme_b", "y")
    both = a.join(b, "model").where("scheme_a < scheme_b")
    return stats.kendall(both, ["scheme_a", "scheme_b"], "model", "x", "y").withColumn("tau", r6("tau"))


RESAMPLED = "WITH {scores}, " + stats.draws_sql("scores", "task", N_DRAWS, 5, "tasks").replace("{", "{{").replace("}", "}}") + """,
pts AS (SELECT draw, model, sum(times * (n_models - r)) AS points FROM ranked JOIN draws USING (task), nm GROUP BY 1, 2),
placed AS (SELECT *, rank() OVER (PARTITION BY draw ORDER BY points DESC) AS place FROM pts)"""


@query(RESAMPLED + """ SELECT model, quantile_cont(place::DOUBLE, 0.025) AS lo, quantile_cont(place::DOUBLE, 0.975) AS hi, round(avg((place = 1)::INT), 6) AS p_best FROM placed GROUP BY 1""")
def qry04_rank_stability(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    n = s.agg(F.countDistinct("model").alias("n_models"))
    ranked = s.withColumn("r", ranking.rank_ties(["task"], F.desc("score"), ["score"])).crossJoin(F.broadcast(n))
    points = ranked.join(stats.draws(s, "task", N_DRAWS, 5, "tasks"), "task").groupBy("draw", "model").agg(F.sum(F.col("times") * (F.col("n_models") - F.col("r"))).alias("points"))
    placed = points.withColumn("place", F.rank().over(Window.partitionBy("draw").orderBy(F.desc("points"))).cast("double"))
    return stats.interval(placed, ["model"], "place").join(placed.groupBy("model").agg(r6(F.avg((F.col("place") == 1).cast("int"))).alias("p_best")), "model")


@query("""WITH {scores}, c AS (SELECT model, capability, avg(r) AS m FROM ranked GROUP BY 1, 2)
SELECT model, round(avg(m), 6) AS balanced, rank() OVER (ORDER BY round(avg(m), 9))::BIGINT AS place FROM c GROUP BY 1""")
def qry05_capability_balanced(spark: SparkSession, d: str) -> DataFrame:
    ranked = scores(spark, d).withColumn("r", ranking.rank_ties(["task"], F.desc("score"), ["score"]))
    means = ranked.groupBy("model", "capability").agg(F.avg("r").alias("m")).groupBy("model").agg(F.avg("m").alias("b"))
    return means.select("model", r6("b").alias("balanced"), F.rank().over(Window.orderBy(F.round("b", 9))).cast("long").alias("place"))


LEFT_OUT = """WITH {scores}, full_ AS (SELECT model, rank() OVER (ORDER BY sum(n_models - r) DESC) AS x FROM ranked, nm GROUP BY 1),
keys AS (SELECT DISTINCT KEY AS left_out FROM scores),
pts AS (SELECT left_out, model, sum(n_models - r) AS points FROM ranked JOIN keys ON KEY <> left_out, nm GROUP BY 1, 2),
part_ AS (SELECT left_out, model, rank() OVER (PARTITION BY left_out ORDER BY points DESC) AS y FROM pts),
p AS (SELECT left_out, model, x, y FROM part_ JOIN full_ USING (model)),
q AS (SELECT a.left_out, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM p a JOIN p b ON a.left_out = b.left_out AND a.model < b.model),
t AS (SELECT left_out, round(sum(sx * sy) / sqrt((sum(sx * sx) * sum(sy * sy))::DOUBLE), 6) AS tau FROM q GROUP BY 1)
SELECT left_out, tau, arg_min(model, (y, model)) AS best, max(abs(x - y))::BIGINT AS max_shift FROM p JOIN t USING (left_out) GROUP BY 1, 2"""


def _left_out(s: DataFrame, key: str) -> DataFrame:
    """For each value of ``key`` left out: tau with the full ranking, the new best and the largest shift of a place."""
    n = s.agg(F.countDistinct("model").alias("n_models"))
    ranked = s.withColumn("r", ranking.rank_ties(["task"], F.desc("score"), ["score"])).crossJoin(F.broadcast(n)).withColumn("p", F.col("n_models") - F.col("r"))
    whole = ranked.groupBy("model").agg(F.sum("p").alias("points")).select("model", F.rank().over(Window.orderBy(F.desc("points"))).alias("x"))
    each = ranked.groupBy(key, "model").agg(F.sum("p").alias("part"))
    # a sum without a part is the whole less that part
    total = each.withColumn("all", F.sum("part").over(Window.partitionBy("model")))
    every = total.select("model", "all").distinct().crossJoin(F.broadcast(s.select(F.col(key).alias("left_out")).distinct()))
    rest = every.join(each.withColumnRenamed(key, "left_out"), ["model", "left_out"], "left").withColumn("points", F.col("all") - F.coalesce("part", F.lit(0.0)))
    places = rest.withColumn("y", F.rank().over(Window.partitionBy("left_out").orderBy(F.desc("points")))).join(whole, "model").select("left_out", "model", "x", "y")
    tau = stats.kendall(places, ["left_out"], "model", "x", "y")
    return places.groupBy("left_out").agg(F.min_by("model", F.struct("y", "model")).alias("best"), F.max(F.abs(F.col("x") - F.col("y"))).cast("long").alias("max_shift")).join(tau, "left_out").select("left_out", r6("tau").alias("tau"), "best", "max_shift")


@query(LEFT_OUT.replace("KEY", "corpus"))
def qry06_leave_one_corpus_out(spark: SparkSession, d: str) -> DataFrame:
    return _left_out(scores(spark, d), "corpus")


@query(LEFT_OUT.replace("KEY", "task"))
def qry08_leave_one_task_out(spark: SparkSession, d: str) -> DataFrame:
    return _left_out(scores(spark, d), "task")


PAIRS = """WITH {scores}, {pairs}, rk AS (SELECT *, rank() OVER (PARTITION BY task_a, task_b ORDER BY x) + (count(*) OVER (PARTITION BY task_a, task_b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY task_a, task_b ORDER BY y) + (count(*) OVER (PARTITION BY task_a, task_b, y) - 1) / 2.0::DOUBLE AS ry FROM duo),
rho AS (SELECT task_a, task_b, ca, cb, count(*) AS n, round(corr(rx, ry), 6) + 0 AS rho FROM rk GROUP BY 1, 2, 3, 4)"""


def _task_pairs(s: DataFrame) -> DataFrame:
    a, b = s.select("model", F.col("task").alias("task_a"), F.col("capability").alias("ca"), F.col("score").alias("x")), s.select("model", F.col("task").alias("task_b"), F.col("capability").alias("cb"), F.col("score").alias("y"))
    return a.join(b, "model").where("task_a < task_b")


def _pair_rho(s: DataFrame) -> DataFrame:
    return stats.spearman(_task_pairs(s), ["task_a", "task_b", "ca", "cb"], "x", "y").withColumn("rho", r6("rho") + 0.0)


@query(PAIRS + " SELECT task_a, task_b, n, rho, (ca = cb) AS same_type FROM rho")
def qry07_redundancy(spark: SparkSession, d: str) -> DataFrame:
    return _pair_rho(scores(spark, d)).select("task_a", "task_b", "n", "rho", (F.col("ca") == F.col("cb")).alias("same_type"))


@query(PAIRS + """, g AS (SELECT CASE WHEN ca = cb THEN 'within_' || ca ELSE 'across' END AS kind, rho FROM rho)
SELECT kind, count(*) AS n, round(median(rho), 6) AS median_rho, round(avg(rho), 6) AS mean_rho, min(rho) AS min_rho, max(rho) AS max_rho FROM g GROUP BY 1""")
def qry25_correlation_groups(spark: SparkSession, d: str) -> DataFrame:
    g = _pair_rho(scores(spark, d)).withColumn("kind", F.when(F.col("ca") == F.col("cb"), F.concat(F.lit("within_"), "ca")).otherwise("across"))
    return g.groupBy("kind").agg(F.count("*").alias("n"), r6(F.percentile("rho", 0.5)).alias("median_rho"), r6(F.avg("rho")).alias("mean_rho"), F.min("rho").alias("min_rho"), F.max("rho").alias("max_rho"))


@query(PAIRS + """, m AS (SELECT task_a AS a, task_b AS b, rho FROM rho UNION ALL SELECT task_b, task_a, rho FROM rho UNION ALL SELECT task, task, 1.0::DOUBLE FROM (SELECT DISTINCT task FROM scores))
SELECT a, b, rho, round(1 - abs(rho), 6) AS distance FROM m""")
def qry46_correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    half = _pair_rho(s).select(F.col("task_a").alias("a"), F.col("task_b").alias("b"), "rho")
    whole = half.union(half.select("b", "a", "rho")).union(s.select("task").distinct().select("task", "task", F.lit(1.0)))
    return whole.withColumn("distance", r6(1 - F.abs("rho")))


@query("""WITH {scores} SELECT task, round(max(score) - min(score), 6) AS spread, round(stddev_samp(score), 6) AS sd, round(median(score), 6) AS median_score, round((max(score) - min(score)) / nullif(stddev_samp(score), 0), 6) AS spread_over_noise FROM scores GROUP BY 1""")
def qry10_saturation(spark: SparkSession, d: str) -> DataFrame:
    spread, sd = F.max("score") - F.min("score"), F.stddev_samp("score")
    return scores(spark, d).groupBy("task").agg(r6(spread).alias("spread"), r6(sd).alias("sd"), r6(F.percentile("score", 0.5)).alias("median_score"), r6(spread / F.nullif(sd, F.lit(0.0))).alias("spread_over_noise"))


@query("WITH {scores}, m AS (SELECT model, family, capability, " + mean6_sql() + """ AS s FROM scores GROUP BY 1, 2, 3), p AS (SELECT *, regexp_extract(model, '(\\d+)', 1)::INT AS params FROM m)
SELECT family, capability, count(*) AS n, round(arg_min(s, params), 6) AS smallest, round(arg_max(s, params), 6) AS largest, round(arg_max(s, params) - arg_min(s, params), 6) AS delta FROM p GROUP BY 1, 2""")
def qry11_scale(spark: SparkSession, d: str) -> DataFrame:
    m = scores(spark, d).groupBy("model", "family", "capability").agg(mean6().alias("s")).withColumn("params", F.regexp_extract("model", r"(\d+)", 1).cast("int"))
    small, large = F.min_by("s", "params"), F.max_by("s", "params")
    return m.groupBy("family", "capability").agg(F.count("*").alias("n"), r6(small).alias("smallest"), r6(large).alias("largest"), r6(large - small).alias("delta"))


@query("""WITH {scores}, m AS (SELECT task, family, round(max(score), 6) AS best FROM scores GROUP BY 1, 2)
SELECT a.task, a.family, a.best, rank() OVER (PARTITION BY a.task ORDER BY a.best DESC)::BIGINT AS place, round(a.best - (SELECT max(b.best) FROM m b WHERE b.task = a.task AND b.family <> a.family), 6) AS gap FROM m a""")
def qry12_exposure_groups(spark: SparkSession, d: str) -> DataFrame:
    m = scores(spark, d).groupBy("task", "family").agg(r6(F.max("score")).alias("best"))
    w = Window.partitionBy("task")
    top = m.withColumn("place", F.rank().over(w.orderBy(F.desc("best"))).cast("long")).withColumn("two", F.slice(F.sort_array(F.collect_list("best").over(w), False), 1, 2))
    holders = top.withColumn("at_top", F.sum((F.col("best") == F.col("two")[0]).cast("int")).over(w))
    other = F.when((F.col("best") == F.col("two")[0]) & (F.col("at_top") == 1), F.col("two")[1]).otherwise(F.col("two")[0])
    return holders.select("task", "family", "best", "place", r6(F.col("best") - other).alias("gap"))


TRADE = """WITH {scores}, m AS (SELECT model, avg(score) FILTER (WHERE capability = 'speaker') AS x, avg(score) FILTER (WHERE capability = 'content') AS y FROM scores GROUP BY 1)"""


@query(TRADE + """, r AS (SELECT rank() OVER (ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY round(x, 9)) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY round(y, 9)) + (count(*) OVER (PARTITION BY round(y, 9)) - 1) / 2.0::DOUBLE AS ry FROM m)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r""")
def qry13_tradeoff(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c: F.round(F.avg(F.when(F.col("capability") == c, F.col("score"))), 9)
    m = scores(spark, d).groupBy("model").agg(mean("speaker").alias("x"), mean("content").alias("y"))
    return stats.spearman(m, [], "x", "y").withColumn("rho", r6("rho"))


@query(PAIRS + ", s AS (SELECT DISTINCT task, corpus FROM scores) SELECT task_a, task_b, rho FROM rho JOIN s a ON a.task = task_a JOIN s b ON b.task = task_b WHERE ca = cb AND a.corpus <> b.corpus")
def qry14_cross_dataset(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    of = s.select("task", "corpus").distinct()
    rows = _pair_rho(s).where("ca = cb").join(of.toDF("task_a", "corpus_a"), "task_a").join(of.toDF("task_b", "corpus_b"), "task_b")
    return rows.where("corpus_a <> corpus_b").select("task_a", "task_b", "rho")


@query("""WITH {scores} SELECT model, task, capability, corpus, CASE WHEN contains(task, '1') THEN 'core' ELSE 'extra' END AS status, floor(score * 10000 + 0.5) / 100 AS score FROM scores""")
def qry15_matrix(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("model", "task", "capability", "corpus", F.when(F.col("task").contains("1"), "core").otherwise("extra").alias("status"), percent("score").alias("score"))


@query("""WITH {scores}, c AS (SELECT task, score AS control FROM scores WHERE model = 'NATION_0')
SELECT task, arg_min(model, (-score, model)) AS best_model, max(score) AS best, round(any_value(control) / max(score), 6) AS control_ratio FROM scores JOIN c USING (task) WHERE model <> 'NATION_0' GROUP BY 1""")
def qry16_task_inventory(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    control = s.where("model = 'NATION_0'").select("task", F.col("score").alias("control"))
    best = ranking.best_rows(s.where("model <> 'NATION_0'"), ["task"], F.desc("score"), F.asc("model"))
    return best.join(control, "task").select("task", F.col("model").alias("best_model"), F.col("score").alias("best"), r6(F.col("control") / F.col("score")).alias("control_ratio"))


@query("""WITH {scores}, m AS (SELECT model, avg(score) AS a, avg(score) FILTER (WHERE contains(task, '1')) AS c FROM scores GROUP BY 1)
SELECT model, rank() OVER (ORDER BY round(a, 9) DESC)::BIGINT AS all_tasks, rank() OVER (ORDER BY round(c, 9) DESC)::BIGINT AS core_only FROM m""")
def qry17_core_only(spark: SparkSession, d: str) -> DataFrame:
    m = scores(spark, d).groupBy("model").agg(F.round(F.avg("score"), 9).alias("a"), F.round(F.avg(F.when(F.col("task").contains("1"), F.col("score"))), 9).alias("c"))
    place = lambda c: F.rank().over(Window.orderBy(F.desc(c))).cast("long")
    return m.select("model", place("a").alias("all_tasks"), place("c").alias("core_only"))


FAMILIES = "WITH {scores}, " + stats.draws_sql("scores", "family", N_FAMILY_DRAWS, 7, "families").replace("{", "{{").replace("}", "}}") + """,
m AS (SELECT model, family, avg(score) FILTER (WHERE capability = 'speaker') AS x, avg(score) FILTER (WHERE capability = 'content') AS y FROM scores GROUP BY 1, 2),
g AS (SELECT draw, sum(times * (x - y)) / sum(times) AS separation FROM m JOIN draws USING (family) GROUP BY 1)"""


@query(FAMILIES + " SELECT round(quantile_cont(separation, 0.025), 6) AS lo, round(quantile_cont(separation, 0.975), 6) AS hi, round(avg((separation < 0)::INT), 6) AS below, count(*) AS n_draws FROM g")
def qry22_family_blocked(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    mean = lambda c: F.avg(F.when(F.col("capability") == c, F.col("score")))
    m = s.groupBy("model", "family").agg(mean("speaker").alias("x"), mean("content").alias("y"))
    per = m.join(stats.draws(s, "family", N_FAMILY_DRAWS, 7, "families"), "family").groupBy("draw").agg((F.sum(F.col("times") * (F.col("x") - F.col("y"))) / F.sum("times")).alias("separation"))
    return stats.interval(per, [], "separation").crossJoin(per.agg(r6(F.avg((F.col("separation") < 0).cast("int"))).alias("below"), F.count("*").alias("n_draws"))).select(r6("lo").alias("lo"), r6("hi").alias("hi"), "below", "n_draws")


@query("WITH {scores}, m AS (SELECT model, capability, " + mean6_sql() + """ AS s FROM scores GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY capability ORDER BY s DESC, model) AS k FROM m)
SELECT capability, k::BIGINT AS place, model, s AS score FROM p WHERE k <= 5""")
def qry23_top_by_capability(spark: SparkSession, d: str) -> DataFrame:
    m = scores(spark, d).groupBy("model", "capability").agg(mean6().alias("score"))
    w = Window.partitionBy("capability").orderBy(F.desc("score"), "model")
    return m.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("capability", "place", "model", "score")


@query("""WITH {scores}, w AS (SELECT regexp_extract(model, '(\\d+)', 1)::INT % 4 AS wave, model, family FROM scores GROUP BY ALL), f AS (SELECT family, min(wave) AS first FROM w GROUP BY 1), n AS (SELECT wave, count(*) AS k FROM w GROUP BY 1), g AS (SELECT first AS wave, count(*) AS new FROM f GROUP BY 1)
SELECT wave, (sum(k) OVER (ORDER BY wave))::BIGINT AS models_so_far, (sum(coalesce(new, 0)) OVER (ORDER BY wave))::BIGINT AS families_so_far FROM n LEFT JOIN g USING (wave)""")
def qry48_wave_coverage(spark: SparkSession, d: str) -> DataFrame:
    w = scores(spark, d).select("model", "family").distinct().withColumn("wave", F.regexp_extract("model", r"(\d+)", 1).cast("int") % 4)
    new = w.groupBy("family").agg(F.min("wave").alias("wave")).groupBy("wave").agg(F.count("*").alias("new"))
    run = Window.orderBy("wave")
    return w.groupBy("wave").agg(F.count("*").alias("k")).join(new, "wave", "left").select("wave", F.sum("k").over(run).alias("models_so_far"), F.sum(F.coalesce("new", F.lit(0))).over(run).alias("families_so_far"))


@query("""WITH {scores} SELECT model, task, score, round((score - min(score) OVER (PARTITION BY task)) / nullif(max(score) OVER (PARTITION BY task) - min(score) OVER (PARTITION BY task), 0), 6) AS shade, score = max(score) OVER (PARTITION BY task) AS is_best FROM scores""")
def qry45_dashboard(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("task")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scores(spark, d).select("model", "task", "score", r6((F.col("score") - lo) / F.nullif(hi - lo, F.lit(0.0))).alias("shade"), (F.col("score") == hi).alias("is_best"))


@query("WITH {scores}, m AS (SELECT model, " + mean6_sql("capability = 'channel'") + " AS a, " + mean6_sql("capability = 'content'") + """ AS l FROM scores GROUP BY 1)
SELECT model, round(a - l, 6) AS gap, CASE WHEN round(a - l, 6) > 0.05 THEN 'acoustic' WHEN round(a - l, 6) < -0.05 THEN 'linguistic' ELSE 'balanced' END AS lean FROM m""")
def qry42_lean(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c: mean6(F.col("capability") == c)
    m = scores(spark, d).groupBy("model").agg(r6(mean("channel") - mean("content")).alias("gap"))
    return m.withColumn("lean", F.when(F.col("gap") > 0.05, "acoustic").when(F.col("gap") < -0.05, "linguistic").otherwise("balanced"))


@query("""WITH {scores}, fp AS (SELECT model, md5(string_agg(printf('%.6f', score), '|' ORDER BY task)) AS print FROM scores GROUP BY 1)
SELECT print, count(*) AS n, min(model) AS kept FROM fp GROUP BY 1""")
def prj15_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    per = scores(spark, d).groupBy("model").agg(F.sort_array(F.collect_list(F.struct("task", "score"))).alias("x"))
    prints = per.select("model", F.md5(F.array_join(F.transform("x", lambda y: F.format_string("%.6f", y["score"])), "|")).alias("print"))
    return prints.groupBy("print").agg(F.count("*").alias("n"), F.min("model").alias("kept"))


@query("WITH {scores} SELECT coalesce(corpus, 'all') AS corpus, coalesce(family, 'all') AS family, count(*) AS n, " + mean6_sql() + " AS mean_score FROM scores GROUP BY GROUPING SETS ((corpus, family), (corpus), ())")
def agg24_subtotals(spark: SparkSession, d: str) -> DataFrame:
    """Means by corpus and family with subtotals, in one pass over the scores."""
    s = scores(spark, d)
    sets = s.groupingSets([["corpus", "family"], ["corpus"], []], "corpus", "family")
    return sets.agg(F.count("*").alias("n"), mean6().alias("mean_score")).select(F.coalesce("corpus", F.lit("all")).alias("corpus"), F.coalesce("family", F.lit("all")).alias("family"), "n", "mean_score")


@query("""WITH r AS (SELECT user_id AS model, event_type AS task, value AS main_score, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value * 2, 4) END AS side FROM events)
SELECT model, task, max(main_score) AS main_score, arg_max(side, main_score) FILTER (WHERE side IS NOT NULL) AS side FROM r GROUP BY 1, 2""")
def agg05_keep_best(spark: SparkSession, d: str) -> DataFrame:
    from ..session import table

    rows = table(spark, d, "events").select(F.col("user_id").alias("model"), F.col("event_type").alias("task"), F.col("value").alias("main_score"), F.when(F.col("event_id") % 3 != 0, F.round(F.col("value") * 2, 4)).alias("side"))
    return ranking.last_known(rows, ["model", "task"], "main_score", ["side"])
