"""Single steps of the larger queries: projections, filters, joins, aggregates, pivots, windows, orders and set operations.

Names begin with the identifier of the step that a query shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keyed import keyed, keyed_sql
from ..session import table
from .base import CAPABILITIES, EVENTS, manifest, mean6, mean6_sql, query, r6, scores, sparse

MODELS = "(SELECT count(DISTINCT model) FROM scores)"


# projections


@query("SELECT doc_id, string_split(concat_ws('_', lang, doc_id), '_')[2] AS second, string_split(concat_ws('_', lang, doc_id), '_')[3] AS third FROM documents")
def prj03_id_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of an identifier by place; null beyond the last (PRJ03)."""
    parts = F.split(F.concat_ws("_", "lang", "doc_id"), "_")
    return table(spark, d, "documents").select("doc_id", F.try_element_at(parts, F.lit(2)).alias("second"), F.try_element_at(parts, F.lit(3)).alias("third"))


@query("SELECT doc_id, concat_ws('__', source, lang, lpad(doc_id::VARCHAR, 9, '0')) AS uid FROM documents")
def prj04_composite_ids(spark: SparkSession, d: str) -> DataFrame:
    """Speaker, prompt and segment as one identifier (PRJ04)."""
    return table(spark, d, "documents").select("doc_id", F.concat_ws("__", "source", "lang", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("uid"))


@query("WITH {scores} SELECT task, lower(corpus) IN ('corpus1', 'corpus3') AS open_licence FROM (SELECT DISTINCT task, corpus FROM scores)")
def prj08_licences(spark: SparkSession, d: str) -> DataFrame:
    """Whether a task's corpus is on the list of open licences (PRJ08)."""
    return scores(spark, d).select("task", "corpus").distinct().select("task", F.lower("corpus").isin("corpus1", "corpus3").alias("open_licence"))


@query("WITH {manifest}, f AS (SELECT speaker_id, min(utt_id) AS first FROM manifest WHERE speaker_id IS NOT NULL GROUP BY 1) SELECT speaker_id, row_number() OVER (ORDER BY first) - 1 AS as_seen, row_number() OVER (ORDER BY speaker_id) - 1 AS by_name FROM f")
def prj13_codes(spark: SparkSession, d: str) -> DataFrame:
    """Numbers for names: in order of first sight, and in order of the names (PRJ13). What is ordered is as long as the names are many."""
    first = manifest(spark, d).where("speaker_id IS NOT NULL").groupBy("speaker_id").agg(F.min("utt_id").alias("first"))
    code = lambda c: (F.row_number().over(Window.orderBy(c)) - 1).cast("long")
    return first.select("speaker_id", code("first").alias("as_seen"), code("speaker_id").alias("by_name"))


@query("WITH {manifest}, g AS (SELECT md5(norm) AS content, count(*) AS n FROM manifest WHERE length(norm) > 0 GROUP BY 1 HAVING count(DISTINCT speaker_id) >= 2) SELECT content, 's' || (row_number() OVER (ORDER BY content) - 1) AS grp, n FROM g")
def prj14_group_ids(spark: SparkSession, d: str) -> DataFrame:
    """Numbered names of content groups (PRJ14)."""
    g = manifest(spark, d).where(F.length("norm") > 0).groupBy(F.md5("norm").alias("content")).agg(F.count("*").alias("n"), F.countDistinct("speaker_id").alias("k")).where("k >= 2")
    return g.select("content", F.concat(F.lit("s"), F.row_number().over(Window.orderBy("content")) - 1).alias("grp"), "n")


@query("WITH {scores}, w AS (SELECT *, max(u) OVER (PARTITION BY task) AS top, rank() OVER (PARTITION BY task ORDER BY u DESC) AS k, rank() OVER (PARTITION BY model ORDER BY u DESC) AS own FROM scores) SELECT model, task, round((u - top) / 1e6::DOUBLE, 6) AS delta, round(u::DOUBLE / nullif(top, 0), 6) AS ratio, (k - own)::BIGINT AS rank_gap FROM w")
def prj16_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Distance and ratio to a task's best, and the gap between two ranks (PRJ16)."""
    top = F.max("u").over(Window.partitionBy("task"))
    place = lambda c: F.rank().over(Window.partitionBy(c).orderBy(F.desc("u")))
    return scores(spark, d).select("model", "task", r6((F.col("u") - top) / 1e6).alias("delta"), r6(F.col("u").cast("double") / F.nullif(top, F.lit(0))).alias("ratio"), (place("task") - place("model")).cast("long").alias("rank_gap"))


@query("WITH {scores} SELECT task, printf('[%+.2f, %+.2f]', ((min(u) + 5000) // 10000)::DOUBLE / 100, ((max(u) + 5000) // 10000)::DOUBLE / 100) AS bounds FROM scores GROUP BY 1")
def prj17_bounds_text(spark: SparkSession, d: str) -> DataFrame:
    """An interval as text, two places, always signed (PRJ17)."""
    two = lambda c: F.expr(f"({c}(u) + 5000) div 10000") / F.lit(100.0)
    return scores(spark, d).groupBy("task").agg(F.format_string("[%+.2f, %+.2f]", two("min"), two("max")).alias("bounds"))


@query("WITH {scores} SELECT DISTINCT task, replace(replace(replace(task, 'Brand', 'B'), '#', '-'), 'B-1', 'core-1') AS short FROM scores")
def prj18_short_names(spark: SparkSession, d: str) -> DataFrame:
    """Names made short by a chain of replacements (PRJ18)."""
    short = F.col("task")
    for a, b in (("Brand", "B"), ("#", "-"), ("B-1", "core-1")):
        short = F.replace(short, F.lit(a), F.lit(b))
    return scores(spark, d).select("task").distinct().select("task", short.alias("short"))


@query("WITH {scores}, w AS (SELECT model, min(score) AS lowest, max(score) AS highest FROM scores GROUP BY 1) SELECT model, 'all tasks' AS subset, kind, score FROM (UNPIVOT w ON lowest, highest INTO NAME kind VALUE score)")
def prj19_long_form(spark: SparkSession, d: str) -> DataFrame:
    """Columns to rows beside a constant column (PRJ19)."""
    wide = scores(spark, d).groupBy("model").agg(F.min("score").alias("lowest"), F.max("score").alias("highest"))
    return wide.unpivot("model", ["lowest", "highest"], "kind", "score").select("model", F.lit("all tasks").alias("subset"), "kind", "score")


@query("SELECT doc_id, coalesce(nullif(concat_ws('; ', CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'not English' END, CASE WHEN contains(text, 'http') THEN 'has a link' END), ''), 'passes') AS reason FROM documents")
def prj20_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Reasons joined by "; ", or "passes" (PRJ20)."""
    why = F.concat_ws("; ", F.when(F.col("n_chars") < 200, "short"), F.when(F.col("lang") != "en", "not English"), F.when(F.col("text").contains("http"), "has a link"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(why, F.lit("")), F.lit("passes")).alias("reason"))


# filters


@query("SELECT vec_id, label FROM embeddings QUALIFY count(*) OVER (PARTITION BY label) >= 4")
def flt03_group_size(spark: SparkSession, d: str) -> DataFrame:
    """Rows of groups with four members (FLT03)."""
    return table(spark, d, "embeddings").withColumn("n", F.count("*").over(Window.partitionBy("label"))).where("n >= 4").select("vec_id", "label")


@query("WITH {scores} SELECT model, task, score FROM scores WHERE NOT starts_with(model, 'NATION_1')")
def flt05_without_controls(spark: SparkSession, d: str) -> DataFrame:
    """All but the control rows, known by a prefix (FLT05)."""
    return scores(spark, d).where(~F.col("model").startswith("NATION_1")).select("model", "task", "score")


@query("WITH {scores}, {sparse} SELECT model, task, score FROM sparse WHERE score IS NOT NULL AND task IN (SELECT p_brand FROM part WHERE p_partkey % 7 = 0)")
def flt06_declared(spark: SparkSession, d: str) -> DataFrame:
    """Scores that are there, of declared tasks only (FLT06)."""
    declared = table(spark, d, "part").where("p_partkey % 7 = 0").select(F.col("p_brand").alias("task"))
    return sparse(spark, d).where("score IS NOT NULL").join(declared, "task", "left_semi").select("model", "task", "score")


@query("WITH {scores}, {sparse} SELECT task, count(score) AS n FROM sparse GROUP BY 1 HAVING count(score) = " + MODELS)
def flt07_complete_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that every model has a score for (FLT07)."""
    s = sparse(spark, d)
    n = s.agg(F.countDistinct("model").alias("n_models"))
    return s.groupBy("task").agg(F.count("score").alias("n")).join(F.broadcast(n), F.col("n") == F.col("n_models")).select("task", "n")


@query("WITH {scores}, {sparse} SELECT model, count(score) AS n, count(score) FILTER (WHERE capability = 'content') AS n_content FROM sparse GROUP BY 1 HAVING count(score) >= 24 AND count(score) FILTER (WHERE capability = 'content') >= 8")
def flt08_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Models with enough scores, in all and in one capability (FLT08)."""
    n = sparse(spark, d).groupBy("model").agg(F.count("score").alias("n"), F.count(F.when(F.col("capability") == "content", F.col("score"))).alias("n_content"))
    return n.where("n >= 24 AND n_content >= 8")


@query("WITH r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS v FROM events) SELECT event_id, v FROM r WHERE v IS NOT NULL AND isfinite(v)")
def flt09_finite(spark: SparkSession, d: str) -> DataFrame:
    """Neither null nor NaN nor infinite (FLT09)."""
    odd = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).when(F.col("event_id") % 13 != 0, F.col("value").cast("double"))
    return table(spark, d, "events").select("event_id", odd.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))


@query("WITH {scores}, t AS (SELECT task, capability, max(score) - min(score) AS spread, avg(score) AS m, stddev_samp(score) AS sd FROM scores GROUP BY 1, 2) SELECT task, round(spread / sd, 6) AS spread_over_noise FROM t WHERE spread / sd < 4")
def flt12_saturated(spark: SparkSession, d: str) -> DataFrame:
    """Tasks whose spread is small beside their noise (FLT12)."""
    x = (F.max("score") - F.min("score")) / F.stddev_samp("score")
    return scores(spark, d).groupBy("task").agg(x.alias("x")).where("x < 4").select("task", r6("x").alias("spread_over_noise"))


@query("""WITH {scores}, t AS (SELECT task, capability, max(u) AS best, max(u) FILTER (WHERE model = 'NATION_0') AS control, min(u) AS chance FROM scores GROUP BY 1, 2),
v AS (SELECT *, CASE WHEN control >= 0.9 * best THEN 'exclude: control is close to the best' WHEN best - chance < 200000 THEN 'exclude: best is close to chance' WHEN capability = 'channel' THEN 'extra: provenance' ELSE 'core' END AS verdict FROM t) SELECT task, verdict FROM v""")
def flt13_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of each task: the first rule that holds; provenance only lowers what would be core (FLT13)."""
    t = scores(spark, d).groupBy("task", "capability").agg(F.max("u").alias("best"), F.max(F.when(F.col("model") == "NATION_0", F.col("u"))).alias("control"), F.min("u").alias("chance"))
    verdict = F.when(F.col("control") >= 0.9 * F.col("best"), "exclude: control is close to the best").when(F.col("best") - F.col("chance") < 200_000, "exclude: best is close to chance").when(F.col("capability") == "channel", "extra: provenance").otherwise("core")
    return t.select("task", verdict.alias("verdict"))


@query("SELECT doc_id, coalesce(contains(CASE WHEN doc_id % 5 > 0 THEN lang END, 'e'), false) AS has_e FROM documents")
def flt15_contains(spark: SparkSession, d: str) -> DataFrame:
    """A substring test that is false for null (FLT15)."""
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 5 > 0, F.col("lang")).contains("e"), F.lit(False)).alias("has_e"))


# joins


@query("SELECT d.doc_id, coalesce(l.quality, -1)::INT AS quality, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)")
def joi01_with_default(spark: SparkSession, d: str) -> DataFrame:
    """Each document with its label, or a default (JOI01)."""
    one = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.lit(True).alias("found"))
    return table(spark, d, "documents").select("doc_id").join(one, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"), F.coalesce("found", F.lit(False)).alias("found"))


@query("SELECT e.vec_id, e.label, d.source AS speaker_id FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def joi02_metadata_of_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Metadata aligned to the rows of a matrix, by id (JOI02)."""
    of = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("speaker_id"))
    return table(spark, d, "embeddings").select("vec_id", "label").join(of, "vec_id")


@query("WITH {scores}, a AS (SELECT task, max(score) AS best FROM scores GROUP BY 1), b AS (SELECT task, avg(u) AS m FROM scores WHERE capability <> 'channel' GROUP BY 1) SELECT task, best, m IS NULL AS lacks_other FROM a LEFT JOIN b USING (task)")
def joi03_left_merge(spark: SparkSession, d: str) -> DataFrame:
    """One table's statistics beside another's, which lacks some keys (JOI03)."""
    s = scores(spark, d)
    b = s.where("capability <> 'channel'").groupBy("task").agg(F.avg("u").alias("m"))
    return s.groupBy("task").agg(F.max("score").alias("best")).join(b, "task", "left").select("task", "best", F.col("m").isNull().alias("lacks_other"))


@query("WITH {scores}, {sparse} SELECT a.model, a.task, a.score AS old, b.score AS new FROM scores a JOIN sparse b ON a.model = b.model AND a.task = b.task WHERE b.score IS NOT NULL")
def joi04_composite_key(spark: SparkSession, d: str) -> DataFrame:
    """Old and new tables by two keys (JOI04)."""
    new = sparse(spark, d).where("score IS NOT NULL").select("model", "task", F.col("score").alias("new"))
    return scores(spark, d).select("model", "task", F.col("score").alias("old")).join(new, ["model", "task"])


@query("WITH {manifest}, m AS (SELECT *, " + keyed_sql(4, "cell", "utt_id") + " % 16 AS cell, " + keyed_sql(4, "place", "utt_id") + " AS h FROM manifest), o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY h, utt_id) AS k FROM m), p AS (SELECT a.utt_id AS q, b.utt_id AS negative, b.k - a.k AS far FROM o a JOIN o b ON a.cell = b.cell AND b.k BETWEEN a.k + 1 AND a.k + 20 AND a.norm <> b.norm AND a.speaker_id <> b.speaker_id) SELECT q, arg_min(negative, far) AS negative, (min(far) - 1)::BIGINT AS rejected FROM p GROUP BY 1")
def joi11_random_negatives(spark: SparkSession, d: str) -> DataFrame:
    """For each row the first of the 20 after it, in a random order, with other text and speaker (JOI11): linear in the rows, whatever one speaker holds."""
    m = manifest(spark, d).select("utt_id", "speaker_id", F.sha2("norm", 256).alias("t"), (keyed(4, "cell", "utt_id") % 16).alias("cell"), keyed(4, "place", "utt_id").alias("h"))
    w = Window.partitionBy("cell").orderBy("h", "utt_id")
    after = F.array(*[F.struct(F.lead("utt_id", j).over(w).alias("u"), F.lead("speaker_id", j).over(w).alias("s"), F.lead("t", j).over(w).alias("t"), F.lit(j).alias("j")) for j in range(1, 21)])
    fit = F.filter("after", lambda x: (x["s"] != F.col("speaker_id")) & (x["t"] != F.col("t")))
    return m.withColumn("after", after).withColumn("first", F.try_element_at(fit, F.lit(1))).where("first.u IS NOT NULL").select(F.col("utt_id").alias("q"), F.col("first.u").alias("negative"), (F.col("first.j") - 1).cast("long").alias("rejected"))


@query("WITH {scores}, {sparse}, a AS (SELECT model, count(score) AS here FROM sparse WHERE capability = 'content' AND model <> 'NATION_2' GROUP BY 1), b AS (SELECT model, count(score) AS there FROM sparse WHERE capability = 'speaker' AND model <> 'NATION_3' GROUP BY 1) SELECT model, coalesce(here, 0) AS here, coalesce(there, 0) AS there FROM a FULL JOIN b USING (model)")
def joi12_both_benchmarks(spark: SparkSession, d: str) -> DataFrame:
    """Coverage in two benchmarks, 0 where a model is in one only (JOI12)."""
    s = sparse(spark, d)
    part = lambda c, without, name: s.where((F.col("capability") == c) & (F.col("model") != without)).groupBy("model").agg(F.count("score").alias(name))
    both = part("content", "NATION_2", "here").join(part("speaker", "NATION_3", "there"), "model", "full")
    return both.select("model", F.coalesce("here", F.lit(0)).alias("here"), F.coalesce("there", F.lit(0)).alias("there"))


@query("WITH {scores}, fresh AS (SELECT model, task, score + 1 AS score FROM scores WHERE " + keyed_sql(6, "fresh", "model", "task") + " % 60 > 0), ready AS (SELECT model FROM fresh GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT task) FROM scores)) SELECT model, task, score, true AS replaced FROM fresh SEMI JOIN ready USING (model) UNION ALL SELECT model, task, score, false FROM scores ANTI JOIN ready USING (model)")
def joi14_overlay(spark: SparkSession, d: str) -> DataFrame:
    """A model's rows give way to corrected ones only if these are complete (JOI14)."""
    s = scores(spark, d).select("model", "task", "score")
    fresh = s.where(keyed(6, "fresh", "model", "task") % 60 > 0).withColumn("score", F.col("score") + 1)
    need = s.agg(F.countDistinct("task").alias("need"))
    ready = fresh.groupBy("model").agg(F.count("*").alias("n")).join(F.broadcast(need), F.col("n") == F.col("need")).select("model")
    return fresh.join(ready, "model", "left_semi").withColumn("replaced", F.lit(True)).unionByName(s.join(ready, "model", "left_anti").withColumn("replaced", F.lit(False)))


@query("WITH {scores}, a AS (SELECT model, max(score) AS best FROM scores GROUP BY 1), b AS (SELECT model, count(*) AS n FROM scores GROUP BY 1) SELECT a.model, best, n FROM a JOIN b USING (model)")
def joi16_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of models side by side (JOI16)."""
    s = scores(spark, d)
    return s.groupBy("model").agg(F.max("score").alias("best")).join(s.groupBy("model").agg(F.count("*").alias("n")), "model")


@query("WITH {manifest}, t AS (SELECT md5(norm) AS text_id, min(utt_id) AS query_id, count(*) AS n_relevant FROM manifest WHERE length(norm) > 0 GROUP BY norm) SELECT t.query_id, m.utt_id AS did FROM t JOIN manifest m ON md5(m.norm) = t.text_id WHERE n_relevant > 1")
def joi17_text_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Every row that shares a query's text is relevant to it (JOI17)."""
    m = manifest(spark, d).where(F.length("norm") > 0).select("utt_id", F.md5("norm").alias("text_id"))
    t = m.groupBy("text_id").agg(F.min("utt_id").alias("query_id"), F.count("*").alias("n")).where("n > 1")
    return t.join(m, "text_id").select("query_id", F.col("utt_id").alias("did"))


# aggregates


@query("WITH {scores} SELECT task, count(*) AS n, " + mean6_sql() + " AS mean, round(stddev_samp(score), 6) AS sd, median(u)::DOUBLE AS median_u FROM scores GROUP BY 1")
def agg02_named(spark: SparkSession, d: str) -> DataFrame:
    """Several named aggregates at once; a task of one row has no deviation (AGG02)."""
    return scores(spark, d).groupBy("task").agg(F.count("*").alias("n"), mean6().alias("mean"), r6(F.stddev_samp("score")).alias("sd"), F.percentile("u", 0.5).alias("median_u"))


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, arg_max(lang, (n, lang)) AS most_common, round(max(n) / sum(n)::DOUBLE, 6) AS share FROM c GROUP BY 1")
def agg14_majority(spark: SparkSession, d: str) -> DataFrame:
    """The most common class and its share (AGG14)."""
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.max_by("lang", F.struct("n", "lang")).alias("most_common"), r6(F.max("n") / F.sum("n").cast("double")).alias("share"))


@query("SELECT label, (vec_id // 1000)::BIGINT AS block, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids FROM embeddings GROUP BY 1, 2")
def agg16_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of each group in order (AGG16): a list for each thousand ids, so that no list grows with its group."""
    rows = table(spark, d, "embeddings").withColumn("block", F.floor(F.col("vec_id") / 1000).cast("long"))
    ids = rows.groupBy("label", "block").agg(F.sort_array(F.collect_list("vec_id")).alias("x"))
    return ids.select("label", "block", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("ids"))


@query("WITH {scores} SELECT capability, bool_and(score > 1) AS all_above, count_if(score > 1.3) AS n_high, bool_or(score > 1.5) AS any_top FROM scores GROUP BY 1")
def agg22_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether all rows pass, and how many (AGG22)."""
    return scores(spark, d).groupBy("capability").agg(F.bool_and(F.col("score") > 1).alias("all_above"), F.count_if(F.col("score") > 1.3).alias("n_high"), F.bool_or(F.col("score") > 1.5).alias("any_top"))


# pivots

_TYPES = ", ".join(f"{mean6_sql(f'capability = {chr(39)}{c}{chr(39)}')} AS {c}" for c in CAPABILITIES)


@query("SELECT user_id, " + ", ".join(f"round(avg(round(value * 100)::BIGINT) FILTER (WHERE event_type = '{t}'), 9) AS {t}" for t in EVENTS) + " FROM events GROUP BY 1")
def piv01_wide_means(spark: SparkSession, d: str) -> DataFrame:
    """Rows to columns by their mean, in hundredths; the columns are stated (PIV01)."""
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", list(EVENTS)).agg(F.round(F.avg(F.round(F.col("value") * 100).cast("long")), 9))


@query("WITH {scores} SELECT model, " + _TYPES + " FROM scores GROUP BY 1")
def piv03_type_means(spark: SparkSession, d: str) -> DataFrame:
    """Means by capability as columns (PIV03)."""
    return scores(spark, d).groupBy("model").pivot("capability", CAPABILITIES).agg(mean6())


@query("WITH {scores} SELECT task, max(score) FILTER (WHERE model = 'NATION_0') AS control, max(score) FILTER (WHERE model = 'NATION_5') AS other, max(n) AS most_rows FROM (SELECT *, count(*) OVER (PARTITION BY model, task) AS n FROM scores) GROUP BY 1")
def piv04_strict(spark: SparkSession, d: str) -> DataFrame:
    """Rows to columns where keys must be unique: most_rows, the most rows of a cell, is 1 (PIV04)."""
    s = scores(spark, d)
    most = s.groupBy("model", "task").agg(F.count("*").alias("n")).groupBy("task").agg(F.max("n").alias("most_rows"))
    wide = s.groupBy("task").pivot("model", ["NATION_0", "NATION_5"]).agg(F.max("score"))
    return wide.select("task", F.col("NATION_0").alias("control"), F.col("NATION_5").alias("other")).join(most, "task")


@query("WITH {scores}, l AS (SELECT unnest(['NATION_4', 'absent', 'NATION_1']) AS model, unnest([1, 2, 3]) AS place), b AS (SELECT model, max(score) AS best FROM scores GROUP BY 1) SELECT l.model, place, best FROM l LEFT JOIN b USING (model)")
def piv07_reindexed(spark: SparkSession, d: str) -> DataFrame:
    """A stated list of models, with nulls for those without rows (PIV07)."""
    listed = spark.createDataFrame([("NATION_4", 1), ("absent", 2), ("NATION_1", 3)], "model string, place int")
    return listed.join(scores(spark, d).groupBy("model").agg(F.max("score").alias("best")), "model", "left")


# windows


@query("WITH {scores}, {sparse} SELECT model, task, score, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY task ORDER BY score DESC NULLS LAST) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0::DOUBLE END AS place FROM sparse")
def win03_missing_rank(spark: SparkSession, d: str) -> DataFrame:
    """What has no score has no rank (WIN03)."""
    rank = F.rank().over(Window.partitionBy("task").orderBy(F.desc_nulls_last("score"))) + (F.count("*").over(Window.partitionBy("task", "score")) - 1) / F.lit(2.0)
    return sparse(spark, d).select("model", "task", "score", F.when(F.col("score").isNotNull(), rank).alias("place"))


@query("WITH {manifest}, k AS (SELECT md5(norm) AS k, count(*) AS n, min(utt_id) AS first FROM manifest GROUP BY 1) SELECT utt_id, n > 1 AS repeated, utt_id = first AS first_of_its_kind FROM manifest JOIN k ON md5(norm) = k.k")
def win09_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text comes again, and which row a drop of repeats would leave (WIN09, WIN10): by aggregation and join, as one text may hold a third of the rows."""
    m = manifest(spark, d).select("utt_id", F.md5("norm").alias("k"))
    per = m.groupBy("k").agg(F.count("*").alias("n"), F.min("utt_id").alias("first"))
    return m.join(per, "k").select("utt_id", (F.col("n") > 1).alias("repeated"), (F.col("utt_id") == F.col("first")).alias("first_of_its_kind"))


@query("WITH {scores}, t AS (SELECT DISTINCT task, capability FROM scores), o AS (SELECT *, row_number() OVER (ORDER BY capability, task) AS place, lag(capability) OVER (ORDER BY capability, task) AS before FROM t) SELECT task, capability, place, capability IS DISTINCT FROM before AS begins_block FROM o")
def win12_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Where a new block of tasks begins in an ordered list (WIN12)."""
    w = Window.orderBy("capability", "task")
    t = scores(spark, d).select("task", "capability").distinct()
    return t.select("task", "capability", F.row_number().over(w).cast("long").alias("place"), (~F.col("capability").eqNullSafe(F.lag("capability").over(w))).alias("begins_block"))


@query("SELECT user_id, arg_max(value, event_id) AS last_value FROM events GROUP BY 1")
def win13_last(spark: SparkSession, d: str) -> DataFrame:
    """The value of the last row of each group (WIN13)."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("last_value"))


# orders


@query("WITH {scores} SELECT model, task, score, row_number() OVER (ORDER BY capability, score DESC, model, task) AS place FROM scores")
def top01_order(spark: SparkSession, d: str) -> DataFrame:
    """Places in an order of several keys, up and down (TOP01)."""
    return scores(spark, d).select("model", "task", "score", F.row_number().over(Window.orderBy("capability", F.desc("score"), "model", "task")).cast("long").alias("place"))


@query("WITH {scores}, b AS (SELECT model, max(score) AS best FROM scores GROUP BY 1) (SELECT 'head' AS side, * FROM b ORDER BY best DESC, model LIMIT 4) UNION ALL (SELECT 'tail', * FROM b ORDER BY best, model LIMIT 4)")
def top02_head_and_tail(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last of an order (TOP02)."""
    b = scores(spark, d).groupBy("model").agg(F.max("score").alias("best"))
    some = lambda side, *by: b.orderBy(*by, "model").limit(4).select(F.lit(side).alias("side"), "*")
    return some("head", F.desc("best")).unionByName(some("tail", F.asc("best")))


@query("WITH {scores}, m AS (SELECT model, capability, " + mean6_sql() + " AS s FROM scores GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY capability ORDER BY s DESC, model) AS up, row_number() OVER (PARTITION BY capability ORDER BY s, model) AS down FROM m) SELECT k, capability, count_if(up <= k) AS n, round(avg(s) FILTER (WHERE up <= k), 5) AS mean_best, max(s) FILTER (WHERE down <= k) AS best_of_worst FROM p CROSS JOIN (SELECT unnest([1, 3, 5]) AS k) GROUP BY ALL")
def top03_best_and_worst(spark: SparkSession, d: str) -> DataFrame:
    """The best and the worst 1, 3 and 5 of each subset (TOP03)."""
    m = scores(spark, d).groupBy("model", "capability").agg(mean6().alias("s"))
    w = Window.partitionBy("capability")
    p = m.select("capability", "s", F.row_number().over(w.orderBy(F.desc("s"), "model")).alias("up"), F.row_number().over(w.orderBy("s", "model")).alias("down"))
    every = p.crossJoin(F.broadcast(spark.createDataFrame([(1,), (3,), (5,)], "k int")))
    return every.groupBy("k", "capability").agg(F.count_if(F.col("up") <= F.col("k")).alias("n"), F.round(F.avg(F.when(F.col("up") <= F.col("k"), F.col("s"))), 5).alias("mean_best"), F.max(F.when(F.col("down") <= F.col("k"), F.col("s"))).alias("best_of_worst"))


@query("WITH p AS ((SELECT 'shortest' AS bucket, doc_id FROM documents ORDER BY n_chars, doc_id LIMIT 20) UNION ALL (SELECT 'longest', doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20) UNION ALL (SELECT 'random', doc_id FROM documents ORDER BY " + keyed_sql(8, "bucket", "doc_id") + ", doc_id LIMIT 20)) SELECT max(bucket) AS bucket, doc_id FROM p GROUP BY doc_id")
def top04_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The shortest, the longest and random rows, each row once (TOP04)."""
    m = table(spark, d, "documents").select("doc_id", "n_chars")
    some = lambda name, *by: m.orderBy(*by, "doc_id").limit(20).select(F.lit(name).alias("bucket"), "doc_id")
    every = some("shortest", "n_chars").union(some("longest", F.desc("n_chars"))).union(some("random", keyed(8, "bucket", "doc_id")))
    return every.groupBy("doc_id").agg(F.max("bucket").alias("bucket"))


@query("WITH {scores}, o AS (SELECT model, task, row_number() OVER (ORDER BY model, task) - 1 AS i FROM scores) SELECT model, task, (i % 4)::BIGINT AS worker FROM o")
def top08_strides(spark: SparkSession, d: str) -> DataFrame:
    """A sorted plan of cells dealt out to four workers in turn (TOP08)."""
    return scores(spark, d).select("model", "task", ((F.row_number().over(Window.orderBy("model", "task")) - 1) % 4).cast("long").alias("worker"))


# sets


@query("WITH {scores}, {sparse}, need AS (SELECT DISTINCT task FROM scores), got AS (SELECT model, task FROM sparse WHERE score IS NOT NULL), short AS (SELECT m.model, n.task FROM (SELECT DISTINCT model FROM scores) m CROSS JOIN need n ANTI JOIN got g ON g.model = m.model AND g.task = n.task) SELECT model, count(s.task) = 0 AS complete, count(s.task) AS n_short FROM (SELECT DISTINCT model FROM scores) LEFT JOIN short s USING (model) GROUP BY 1")
def set05_superset(spark: SparkSession, d: str) -> DataFrame:
    """Whether a model has all that is needed (SET05)."""
    s = sparse(spark, d)
    n = s.agg(F.countDistinct("task").alias("need"))
    got = s.groupBy("model").agg(F.count("score").alias("got")).crossJoin(F.broadcast(n))
    return got.select("model", (F.col("need") == F.col("got")).alias("complete"), (F.col("need") - F.col("got")).alias("n_short"))


@query("WITH {scores}, a AS (SELECT DISTINCT capability, corpus FROM scores) SELECT x.capability AS left_set, y.capability AS right_set, NOT EXISTS (SELECT corpus FROM a WHERE capability = x.capability EXCEPT SELECT corpus FROM a WHERE capability = y.capability) AND NOT EXISTS (SELECT corpus FROM a WHERE capability = y.capability EXCEPT SELECT corpus FROM a WHERE capability = x.capability) AS equal FROM (SELECT DISTINCT capability FROM a) x JOIN (SELECT DISTINCT capability FROM a) y ON x.capability < y.capability")
def set06_equal_sets(spark: SparkSession, d: str) -> DataFrame:
    """Whether two halves hold the same members (SET06)."""
    a = scores(spark, d).select("capability", "corpus").distinct().groupBy("capability").agg(F.sort_array(F.collect_set("corpus")).alias("x"))
    return a.toDF("left_set", "l").join(a.toDF("right_set", "r"), F.col("left_set") < F.col("right_set")).select("left_set", "right_set", (F.col("l") == F.col("r")).alias("equal"))
