"""Tests and resampling of correlations, corrected scores, reranking sets and linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import keyed, keyed_sql
from ..operators import linkage, ranking, rerank, stats
from ..session import table
from .base import manifest, query, r6, scores
from .leaderboards import PAIRS, _pair_rho

SEED = 13
PERMUTATIONS, DRAWS, SUBSAMPLES = 10_000, 10_000, 500


def _means(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c: F.round(F.avg(F.when(F.col("capability") == c, F.col("score"))), 9)
    return scores(spark, d).groupBy("model", "family").agg(mean("speaker").alias("x"), mean("content").alias("y"), mean("channel").alias("z"))


def mean_rank(c: str, within: str = "") -> str:
    """Mean rank of ties in DuckDB."""
    part = f"PARTITION BY {within} " if within else ""
    return f"rank() OVER ({part}ORDER BY {c}) + (count(*) OVER (PARTITION BY {within + ', ' if within else ''}{c}) - 1) / 2.0::DOUBLE"


MEANS = """WITH {scores}, m AS (SELECT model, family, round(avg(score) FILTER (WHERE capability = 'speaker'), 9) AS x, round(avg(score) FILTER (WHERE capability = 'content'), 9) AS y, round(avg(score) FILTER (WHERE capability = 'channel'), 9) AS z FROM scores GROUP BY 1, 2)"""


@query(MEANS + f""", r AS (SELECT model, {mean_rank("x")} AS rx, {mean_rank("y")} AS ry, row_number() OVER (ORDER BY model) AS slot FROM m),
dealt AS (SELECT draw, rx, row_number() OVER (PARTITION BY draw ORDER BY {keyed_sql(SEED, "perm", "draw", "model")}, model) AS slot FROM r CROSS JOIN (SELECT unnest(range({PERMUTATIONS})) AS draw)),
each AS (SELECT draw, round(corr(dealt.rx, r.ry), 9) AS b FROM dealt JOIN r USING (slot) GROUP BY draw), seen AS (SELECT count(*) AS n_items, round(corr(rx, ry), 9) AS o FROM r)
SELECT n_items, round(o, 6) AS rho, round((1 + count(*) FILTER (WHERE abs(b) >= abs(o))) / {PERMUTATIONS + 1}.0::DOUBLE, 6) AS p FROM each CROSS JOIN seen GROUP BY n_items, o""")
def sta06_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Whether capabilities trade off: permutation test of the models' mean scores."""
    return stats.permuted(_means(spark, d), "model", "x", "y", PERMUTATIONS, SEED).select("n_items", r6("rho").alias("rho"), r6("p").alias("p"))


@query(PAIRS + f""", k AS (SELECT {mean_rank("rho")} AS r, (ca = cb) AS same, count(*) OVER (PARTITION BY rho) AS t FROM rho WHERE rho IS NOT NULL),
s AS (SELECT count(*) FILTER (WHERE same) AS n1, count(*) FILTER (WHERE NOT same) AS n2, sum(r) FILTER (WHERE same) AS s, sum(t::DOUBLE * t - 1) AS ties FROM k),
u AS (SELECT n1, n2, s - n1 * (n1 + 1) / 2.0::DOUBLE AS u, (s - n1 * (n1 + 1) / 2.0::DOUBLE - n1 * n2 / 2.0::DOUBLE) / sqrt(n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s)
SELECT n1, n2, u, round(z, 6) AS z, round({stats.two_sided_sql("z")}, 6) AS p FROM u""")
def sta05_mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of tasks within one capability against those across."""
    pairs = _pair_rho(scores(spark, d)).withColumn("same", F.col("ca") == F.col("cb"))
    return stats.mann_whitney(pairs, "rho", "same").select("n1", "n2", "u", r6("z").alias("z"), r6("p").alias("p"))


@query(MEANS + f""", {stats.draws_sql("m", "model", DRAWS, SEED, "pair")},
rows AS (SELECT draw, x, y, z, unnest(range(times)) AS copy FROM draws JOIN m USING (model)),
k AS (SELECT draw, {mean_rank("x", "draw")} AS rx, {mean_rank("y", "draw")} AS ry, {mean_rank("z", "draw")} AS rz FROM rows),
each AS (SELECT draw, round(corr(rx, ry) - corr(rx, rz), 9) AS gap FROM k GROUP BY draw)
SELECT count(*) AS n_draws, round(median(gap), 6) AS median_gap, round(quantile_cont(gap, 0.025), 6) AS lo, round(quantile_cont(gap, 0.975), 6) AS hi, round(avg((gap < 0)::INT), 6) AS below FROM each""")
def boo08_paired_difference(spark: SparkSession, d: str) -> DataFrame:
    """Difference of two rank correlations over the same draws of models."""
    m = _means(spark, d)
    drawn = stats.draws(m, "model", DRAWS, SEED, "pair").join(m, "model").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    one, two = stats.spearman(drawn, ["draw"], "x", "y").select("draw", F.col("rho").alias("a")), stats.spearman(drawn, ["draw"], "x", "z").select("draw", F.col("rho").alias("b"))
    each = one.join(two, "draw").withColumn("gap", F.round(F.col("a") - F.col("b"), 9))
    return each.agg(F.count("*").alias("n_draws"), r6(F.percentile("gap", 0.5)).alias("median_gap"), r6(F.percentile("gap", 0.025)).alias("lo"), r6(F.percentile("gap", 0.975)).alias("hi"), r6(F.avg((F.col("gap") < 0).cast("int"))).alias("below"))


@query(MEANS + f""", one AS (SELECT draw, x, y FROM m CROSS JOIN (SELECT unnest(range({SUBSAMPLES})) AS draw) QUALIFY row_number() OVER (PARTITION BY draw, family ORDER BY {keyed_sql(SEED, "family", "draw", "model")}, model) = 1),
k AS (SELECT draw, {mean_rank("x", "draw")} AS rx, {mean_rank("y", "draw")} AS ry FROM one), each AS (SELECT draw, count(*) AS n, corr(rx, ry) AS rho FROM k GROUP BY draw)
SELECT count(*) AS n_draws, max(n) AS n_families, round(median(rho), 6) AS median_rho, round(quantile_cont(rho, 0.025), 6) AS lo, round(quantile_cont(rho, 0.975), 6) AS hi FROM each""")
def boo06_one_per_family(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of capabilities with one model of each family at a time."""
    every = _means(spark, d).crossJoin(spark.range(SUBSAMPLES).withColumnRenamed("id", "draw"))
    one = ranking.best_rows(every, ["draw", "family"], keyed(SEED, "family", "draw", "model"), F.col("model"))
    each = stats.spearman(one, ["draw"], "x", "y")
    return each.agg(F.count("*").alias("n_draws"), F.max("n").alias("n_families"), r6(F.percentile("rho", 0.5)).alias("median_rho"), r6(F.percentile("rho", 0.025)).alias("lo"), r6(F.percentile("rho", 0.975)).alias("hi"))


BORDA_SQL = "SELECT model, sum(n - r) AS points, rank() OVER (ORDER BY sum(n - r) DESC) AS place FROM (SELECT model, (SELECT count(DISTINCT model) FROM {t}) AS n, rank() OVER (PARTITION BY task ORDER BY score DESC) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0::DOUBLE AS r FROM {t}) GROUP BY model"


@query("WITH {scores}, fixed AS (SELECT model, task, round(score * 1.01, 6) AS score FROM scores WHERE family = 'ASIA'), left_in AS (SELECT s.model, s.task, coalesce(f.score, s.score) AS score FROM scores s LEFT JOIN fixed f USING (model, task) WHERE s.model NOT IN ('NATION_7', 'NATION_13')), before AS (" + BORDA_SQL.replace("{t}", "scores") + "), after AS (" + BORDA_SQL.replace("{t}", "left_in") + """)
SELECT b.model, b.place AS place_before, a.place AS place_after, b.place - a.place AS shift, CASE WHEN a.model IS NULL THEN 'excluded' WHEN b.model IN (SELECT model FROM fixed) THEN 'corrected' ELSE 'kept' END AS status FROM before b LEFT JOIN after a USING (model)""")
def qry24_revalidation(spark: SparkSession, d: str) -> DataFrame:
    """Ranks before and after some models are left out and others get corrected scores."""
    s = scores(spark, d)
    fixed = s.where("family = 'ASIA'").select("model", "task", F.round(F.col("score") * 1.01, 6).alias("fixed"))
    after = s.join(fixed, ["model", "task"], "left").where(~F.col("model").isin("NATION_7", "NATION_13")).select("model", "task", F.coalesce("fixed", "score").alias("score"))
    b, a = ranking.borda(s).select("model", F.col("rank").alias("place_before")), ranking.borda(after).select("model", F.col("rank").alias("place_after"))
    touched = fixed.select("model").distinct().withColumn("touched", F.lit(True))
    status = F.when(F.col("place_after").isNull(), "excluded").when(F.col("touched"), "corrected").otherwise("kept")
    return b.join(a, "model", "left").join(touched, "model", "left").select("model", "place_before", "place_after", (F.col("place_before") - F.col("place_after")).alias("shift"), status.alias("status"))


HARD, EASY = 20, 20


@query(f"""WITH {{manifest}}, held AS (SELECT norm FROM manifest WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT speaker_id) >= 2), q AS (SELECT m.* FROM manifest m JOIN held USING (norm)),
hard AS (SELECT utt_id, speaker_id, norm FROM manifest WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY speaker_id ORDER BY {keyed_sql(SEED, "hard", "utt_id")}, utt_id) <= {HARD}),
easy AS (SELECT utt_id, norm FROM manifest WHERE norm <> '' ORDER BY {keyed_sql(SEED, "easy", "utt_id")}, utt_id LIMIT {EASY}),
c AS (SELECT q.utt_id AS qid, p.utt_id AS did, 1 AS rel FROM q JOIN q p ON q.norm = p.norm AND q.speaker_id <> p.speaker_id
UNION SELECT q.utt_id, h.utt_id, 0 FROM q JOIN hard h ON q.speaker_id = h.speaker_id AND q.norm <> h.norm UNION SELECT q.utt_id, e.utt_id, 0 FROM q JOIN easy e ON q.norm <> e.norm)
SELECT qid, sum(rel)::BIGINT AS n_positive, count(*) - sum(rel)::BIGINT AS n_negative, sum(did)::BIGINT AS did_sum FROM c GROUP BY qid HAVING sum(rel) > 0 AND sum(rel) < count(*)""")
def smp08_rerank_sets(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each query: the same text by others, and at most HARD other texts of its speaker and EASY of any. Copies are counted for each query, not listed."""
    m = manifest(spark, d).select("utt_id", "speaker_id", "norm").where("norm <> ''")
    held = m.groupBy("norm").agg(F.countDistinct("speaker_id").alias("k"), F.count("*").alias("n"), F.sum("utt_id").alias("s")).where("k >= 2")
    own = m.groupBy("norm", "speaker_id").agg(F.count("*").alias("own_n"), F.sum("utt_id").alias("own_s"))
    q = m.join(held, "norm").join(own, ["norm", "speaker_id"]).withColumn("n_positive", F.col("n") - F.col("own_n")).withColumn("pos_sum", F.col("s") - F.col("own_s"))
    hard = ranking.best_rows(m, ["speaker_id"], keyed(SEED, "hard", "utt_id"), F.col("utt_id"), k=HARD).select(F.col("utt_id").alias("did"), "speaker_id", F.col("norm").alias("dn"))
    easy = m.orderBy(keyed(SEED, "easy", "utt_id"), "utt_id").limit(EASY).select(F.col("utt_id").alias("did"), F.col("norm").alias("dn"))
    ids = q.select(F.col("utt_id").alias("qid"), "speaker_id", "norm")
    negative = ids.join(hard, "speaker_id").where("norm <> dn").select("qid", "did").union(ids.crossJoin(F.broadcast(easy)).where("norm <> dn").select("qid", "did")).distinct()
    counts = negative.groupBy("qid").agg(F.count("*").alias("n_negative"), F.sum("did").alias("neg_sum"))
    out = q.withColumnRenamed("utt_id", "qid").join(counts, "qid").where("n_positive > 0")
    return out.select("qid", "n_positive", "n_negative", (F.col("pos_sum") + F.col("neg_sum")).alias("did_sum"))


RERANK = "WITH {manifest}, m AS (SELECT utt_id AS did, speaker_id AS h, CASE WHEN length(norm) > 0 THEN md5(norm) END AS k FROM manifest), "


def _told(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).select("utt_id", "speaker_id", F.when(F.length("norm") > 0, F.md5("norm")).alias("k"))


def rerank_rows(spark: SparkSession, d: str) -> DataFrame:
    """2,000 queries, each with all rows of its text by others, 100 rows of its speaker and 100 of any."""
    return rerank.candidates(_told(spark, d), "k", "speaker_id", "utt_id", 2000, 100, 100, SEED, False)


def closed_rows(spark: SparkSession, d: str) -> DataFrame:
    """500 queries, each with all rows of its text by others and 100 other texts of its speaker."""
    return rerank.candidates(_told(spark, d), "k", "speaker_id", "utt_id", 500, 100, 0, SEED, True)


@query(RERANK + rerank.candidates_sql("m", 2000, 100, 100, SEED, False) + " SELECT qid, did, rel FROM cands")
def smp08_rerank_rows(spark: SparkSession, d: str) -> DataFrame:
    """The candidate rows of reranking with the reference's sizes (SMP08)."""
    return rerank_rows(spark, d)


@query(f"""WITH {{manifest}}, held AS (SELECT norm FROM manifest WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT speaker_id) >= 2),
q AS (SELECT m.* FROM manifest m JOIN held USING (norm) ORDER BY {keyed_sql(SEED, "rerank", "utt_id")}, utt_id LIMIT 2000),
pos AS (SELECT q.utt_id AS qid, p.utt_id AS did FROM q JOIN manifest p ON q.norm = p.norm AND q.speaker_id <> p.speaker_id),
hard AS (SELECT q.utt_id AS qid, h.utt_id AS did FROM q JOIN manifest h ON q.speaker_id = h.speaker_id AND q.utt_id <> h.utt_id QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {keyed_sql(SEED, "hard", "q.utt_id", "h.utt_id")}, h.utt_id) <= 100),
easy AS (SELECT q.utt_id AS qid, e.utt_id AS did FROM q CROSS JOIN manifest e QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {keyed_sql(SEED, "easy", "q.utt_id", "e.utt_id")}, e.utt_id) <= 100),
c AS (SELECT qid, did, max(rel) AS rel FROM (SELECT qid, did, 1 AS rel FROM pos UNION ALL SELECT qid, did, 0 FROM hard UNION ALL SELECT qid, did, 0 FROM easy WHERE qid <> did) GROUP BY 1, 2)
SELECT qid, sum(rel)::BIGINT AS n_positive, count(*) - sum(rel)::BIGINT AS n_negative, sum(did)::BIGINT AS did_sum FROM c GROUP BY qid HAVING sum(rel) > 0 AND sum(rel) < count(*)""")
def smp08_rerank_sets_default(spark: SparkSession, d: str) -> DataFrame:
    """With the reference's sizes: 2,000 queries, each with all rows of its text by others, 100 rows of its speaker and 100 of any, drawn for each query."""
    m = manifest(spark, d).select("utt_id", "speaker_id", F.when(F.length("norm") > 0, F.sha2("norm", 256)).alias("k")).cache()
    held = m.where("k IS NOT NULL").groupBy("k").agg(F.countDistinct("speaker_id").alias("n")).where("n >= 2").select("k")
    q = F.broadcast(m.join(held, "k").orderBy(keyed(SEED, "rerank", "utt_id"), "utt_id").limit(2000).select(F.col("utt_id").alias("qid"), F.col("speaker_id").alias("qs"), F.col("k").alias("qk")))
    rows = m.withColumnRenamed("utt_id", "did")
    # the 100 least of n hashes lie below this share of them, but for a chance below 1e-60
    below = min(1.0, 600 / max(1, m.count())) * 2**32
    pos = q.join(rows, F.col("qk") == F.col("k")).where("qs <> speaker_id").select("qid", "did", F.lit(1).alias("rel"))
    order = lambda salt: keyed(SEED, salt, "qid", "did")
    sizes = m.groupBy(F.col("speaker_id").alias("qs")).agg(F.count("*").alias("n"))
    own = q.join(F.broadcast(q.select("qs").distinct().join(sizes, "qs")), "qs").join(rows, F.col("qs") == F.col("speaker_id")).where("qid <> did")
    hard = ranking.best_rows(own.where(order("hard") < F.least(F.lit(1.0), 600 / F.col("n")) * 2**32).select("qid", "did"), ["qid"], order("hard"), F.col("did"), k=100)
    easy = ranking.best_rows(rows.select("did").crossJoin(q.select("qid")).where(order("easy") < below), ["qid"], order("easy"), F.col("did"), k=100).where("qid <> did")
    c = pos.unionByName(hard.unionByName(easy).select("qid", "did", F.lit(0).alias("rel"))).groupBy("qid", "did").agg(F.max("rel").alias("rel"))
    out = c.groupBy("qid").agg(F.sum("rel").alias("n_positive"), F.sum(1 - F.col("rel")).alias("n_negative"), F.sum("did").alias("did_sum"))
    return out.where("n_positive > 0 AND n_negative > 0")


@query(RERANK + rerank.candidates_sql("m", 500, 100, 0, SEED, True) + """, ls AS (SELECT qid AS id, sum(rel) AS n_positive, sum(1 - rel) AS n_negative FROM cands GROUP BY 1), mb AS (SELECT did AS id, count(*) AS n_lists FROM cands GROUP BY 1)
SELECT id, n_positive IS NOT NULL AS is_query, coalesce(n_positive, 0)::BIGINT AS n_positive, coalesce(n_negative, 0)::BIGINT AS n_negative, coalesce(n_lists, 0)::BIGINT AS n_lists FROM mb FULL JOIN ls USING (id)""")
def smp07_rerank_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The corpus closed over queries, their positives and capped negatives of their speakers, and who is in whose list (SMP07)."""
    return rerank.closure(closed_rows(spark, d))


@query(RERANK + rerank.candidates_sql("m", 500, 100, 0, SEED, True) + """, co AS (SELECT did AS id FROM cands UNION SELECT qid FROM cands), pl AS (SELECT id, row_number() OVER (ORDER BY """ + keyed_sql(SEED, "corpus", "id") + """, id) - 1 AS place FROM co)
SELECT qid, place // 32768 + 1 AS bucket, count(*) AS n_members, sum(rel)::BIGINT AS n_relevant, max(place % 32768)::BIGINT AS last FROM cands JOIN pl ON id = did GROUP BY 1, 2""")
def smp07_rerank_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """Each query's list as bits over that corpus: how many are set, how many of relevant rows, and the last (SMP07)."""
    found = closed_rows(spark, d)
    bits = rerank.bitmaps(found, rerank.closure(found), SEED)
    # bytes stand in order, the lowest bit of each first
    size = F.length(F.rtrim(F.hex("members"), F.lit("0")))
    last = F.floor((size + 1) / 2) - 1
    byte = F.conv(F.substring(F.hex("members"), (2 * last + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    top = F.floor(F.log2(byte.cast("double")))
    return bits.select("qid", "bucket", F.call_function("bitmap_count", "members").alias("n_members"), F.call_function("bitmap_count", "relevant").alias("n_relevant"), (8 * last + top).cast("long").alias("last"))


SECOND = """WITH turns AS (SELECT conv_id * 1000 + coalesce(turn, 0) AS utt_id, conv_id % 97 AS speaker_id, md5(coalesce(text, '')) AS prompt FROM conversations WHERE conv_id IS NOT NULL),
cl AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY """ + keyed_sql(SEED, "second", "utt_id") + """, utt_id) AS r, least(count(*) OVER (PARTITION BY speaker_id), 30) AS n FROM turns),
split AS (SELECT *, CASE WHEN r <= greatest(1, round_even(n * 0.3::DOUBLE, 0)) THEN 'test' ELSE 'train' END AS part FROM cl WHERE r <= 30 AND n > 1)"""


@query(SECOND + ", usable AS (SELECT prompt FROM turns GROUP BY 1 HAVING count(DISTINCT speaker_id) > 1) SELECT 'classification' AS task, part, count(*) AS n, count(DISTINCT speaker_id) AS n_speakers, min(utt_id) AS first FROM split GROUP BY part UNION ALL SELECT 'retrieval', 'test', count(*), count(DISTINCT speaker_id), min(utt_id) FROM turns JOIN usable USING (prompt) HAVING count(*) > 0")
def smp11_second_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Another corpus (turns of conversations) as tasks: at most 30 rows of each speaker split for classification, and the prompts of several speakers for retrieval (SMP11)."""
    turns = table(spark, d, "conversations").where("conv_id IS NOT NULL").select((F.col("conv_id") * 1000 + F.coalesce("turn", F.lit(0))).alias("utt_id"), (F.col("conv_id") % 97).alias("speaker_id"), F.md5(F.coalesce("text", F.lit(""))).alias("prompt"))
    placed = rerank.numbered(turns, keyed(SEED, "second", "utt_id"), "utt_id", "speaker_id").where("place < 30").withColumn("n", F.least("size", F.lit(30))).where("n > 1")
    split = placed.withColumn("part", F.when(F.col("place") < F.greatest(F.lit(1), F.bround(F.col("n") * 0.3)), "test").otherwise("train"))
    sums = [F.count("*").alias("n"), F.countDistinct("speaker_id").alias("n_speakers"), F.min("utt_id").alias("first")]
    one = split.groupBy(F.lit("classification").alias("task"), "part").agg(*sums)
    usable = turns.groupBy("prompt").agg(F.min("speaker_id").alias("a"), F.max("speaker_id").alias("b")).where("a <> b").select("prompt")
    return one.unionByName(turns.join(usable, "prompt").groupBy(F.lit("retrieval").alias("task"), F.lit("test").alias("part")).agg(*sums))


@query()
def qry09_reduced_groups(spark: SparkSession, d: str) -> DataFrame:
    """Tasks in 4, 5 and 6 groups by average linkage of 1 - |rho|."""
    pairs = _pair_rho(scores(spark, d)).withColumn("distance", 1 - F.abs("rho"))
    return linkage.linked(pairs, "task_a", "task_b", "distance", (4, 5, 6)).withColumnRenamed("item", "task")
