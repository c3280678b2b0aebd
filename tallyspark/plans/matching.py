"""Content against speaker on matched triples of texts: partners from the tables, vectors from the texts (QRY18, QRY30, QRY37, QRY40, VEC13, VEC15).

The tables have no vectors of their texts, so these are made: a layer is an eighth of a text, its vector the counts of sixteen
letters in it. Two texts that begin with the same five words count as one content: copies and near copies.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.keyed import keyed_sql
from ..operators import durations, retrieval, sampling, stats
from ..session import table, written
from .base import manifest, query, r6

LETTERS, LAYERS, UNIFORM = "abcdefghijklmnop", 8, -1
CLUSTER_DRAWS = 2_000
_ABC = "[" + ", ".join(f"'{c}'" for c in LETTERS) + "]"

TEXTS = "WITH {manifest}, m AS (SELECT utt_id AS i, speaker_id AS h, md5(array_to_string(string_split(norm, ' ')[:5], ' ')) AS k, duration, norm FROM manifest WHERE length(norm) > 0 AND speaker_id IS NOT NULL), "
TRIPLES = TEXTS + durations.near_partner_sql("m", seed=41) + """,
ring AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY """ + keyed_sql(41, "content", "i") + """, i) AS n FROM m),
x AS (SELECT a.i, arg_min(b.i, (b.n < a.n, b.n)) AS content, arg_min(a.norm = b.norm, (b.n < a.n, b.n)) AS exact FROM ring a JOIN ring b ON a.k = b.k AND a.h <> b.h GROUP BY 1),
t AS (SELECT x.i AS q, m.h AS speaker, content, partner AS other, far = 0 AS strict, exact FROM x JOIN partners USING (i) JOIN m USING (i))"""
COUNTS = ", cut AS (SELECT i, layer, list_transform(" + _ABC + """, lambda c: (length(s) - length(replace(s, c, '')))::DOUBLE) AS e FROM (SELECT i, layer, CASE WHEN layer < 0 THEN norm ELSE substr(norm, 1 + length(norm) * layer // 8, length(norm) * (layer + 1) // 8 - length(norm) * layer // 8) END AS s FROM m CROSS JOIN (SELECT unnest(range(-1, 8)) AS layer))),
lay AS (SELECT i, layer, list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-8)) AS vec FROM cut)"""
PREFERENCES = TRIPLES + COUNTS + """, tri AS (SELECT l.layer, speaker, strict, round(list_inner_product(l.vec, c.vec), 9) AS content_sim, round(list_inner_product(l.vec, s.vec), 9) AS speaker_sim FROM t JOIN lay l ON l.i = q JOIN lay c ON c.layer = l.layer AND c.i = content JOIN lay s ON s.layer = l.layer AND s.i = other),
p AS (SELECT *, CASE WHEN abs(content_sim - speaker_sim) <= 1e-6 THEN 5 WHEN content_sim > speaker_sim THEN 10 ELSE 0 END AS pref FROM tri)"""
DRAWS = ", " + stats.draws_sql("t", "speaker", CLUSTER_DRAWS, 43, "clusters").replace("{", "{{").replace("}", "}}")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """utt_id, speaker_id, k (the content), duration and norm of all rows with a text and a speaker."""
    m = manifest(spark, d).where("length(norm) > 0 AND speaker_id IS NOT NULL")
    return m.select("utt_id", "speaker_id", F.md5(F.substring_index("norm", " ", 5)).alias("k"), "duration", "norm")


def triples(spark: SparkSession, d: str) -> DataFrame:
    """q, speaker, content (the same content by another speaker), exact (whether its text is the same too), other (another content of the speaker) and strict (near in duration). Rows without either partner are left out."""
    m = written(texts(spark, d).withColumn("text", F.md5("norm")).drop("norm"))  # narrow rows, which all that follows reads in place of texts
    content = sampling.next_other(m, "k", "speaker_id", "utt_id", "content", seed=41).where("other IS NOT NULL").select(F.col("utt_id").alias("q"), F.col("speaker_id").alias("speaker"), "text", F.col("other").alias("content"))
    partner = durations.near_partner(m, "speaker_id", "k", "duration", "utt_id", seed=41).select(F.col("utt_id").alias("q"), F.col("partner").alias("other"), (F.col("far") == 0).alias("strict"))
    other = m.select(F.col("utt_id").alias("content"), F.col("text").alias("theirs"))
    return content.join(partner, "q").join(other, "content").select("q", "speaker", "content", (F.col("text") == F.col("theirs")).alias("exact"), "other", "strict")


def layered(m: DataFrame) -> DataFrame:
    """utt_id and counts: how often each of ``LETTERS`` stands in each eighth of the text, and in the whole one last. A text is read once."""
    first, size = ord(LETTERS[0]), len(LETTERS)

    def counted(text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) - first
        at = np.flatnonzero((code >= 0) & (code < size))
        edges = np.arange(1, LAYERS) * len(text) // LAYERS
        each = np.bincount(np.searchsorted(edges, at, "right") * size + code[at], minlength=LAYERS * size).reshape(LAYERS, size)
        return np.vstack([each, each.sum(0)]).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.float64()))
        for b in batches:
            every = [counted(t) for t in b.column("norm").to_pylist()]
            flat = pa.array(np.concatenate(every).ravel() if every else np.zeros(0))
            inner = pa.ListArray.from_arrays(pa.array(np.arange(len(every) * (LAYERS + 1) + 1, dtype=np.int32) * size), flat)
            outer = pa.ListArray.from_arrays(pa.array(np.arange(len(every) + 1, dtype=np.int32) * (LAYERS + 1)), inner)
            yield pa.RecordBatch.from_pydict({"utt_id": b.column("utt_id"), "counts": outer.cast(kind)})

    ident = m.schema["utt_id"].dataType.simpleString()
    return m.select("utt_id", "norm").mapInArrow(run, f"utt_id {ident}, counts array<array<double>>")


def preferences(spark: SparkSession, d: str) -> DataFrame:
    """layer, speaker, strict, content_sim, speaker_sim and pref (10 if the content's vector is nearer, 5 if as near, else 0) of each triple and layer (MET10); vectors are joined to the rows that need them."""
    units = layered(texts(spark, d)).select("utt_id", F.transform("counts", lambda v: V.unit(v)).alias("v"))
    rows = triples(spark, d).drop("exact")
    for c in ("q", "content", "other"):
        rows = rows.join(units.select(F.col("utt_id").alias(c), F.col("v").alias(f"{c}_v")), c)
    sims = lambda a, b: F.transform(F.zip_with(a, b, lambda x, y: V.dot(x, y)), lambda s: F.round(s, 9))
    both = rows.select("speaker", "strict", F.posexplode(F.arrays_zip(sims("q_v", "content_v").alias("c"), sims("q_v", "other_v").alias("s"))).alias("at", "x"))
    gap = F.col("x.c") - F.col("x.s")
    return written(both.select(F.when(F.col("at") == LAYERS, UNIFORM).otherwise(F.col("at")).alias("layer"), "speaker", "strict", F.col("x.c").alias("content_sim"), F.col("x.s").alias("speaker_sim"), F.when(F.abs(gap) <= 1e-6, 5).when(gap > 0, 10).otherwise(0).alias("pref")))


def cluster_bootstrap(rows: DataFrame, within: Sequence[str], cluster: str, value: Column, clusters: DataFrame, n: int = CLUSTER_DRAWS, seed: int = 43) -> DataFrame:
    """``within``, lo, hi: the mean of ``value`` over samples of whole ``clusters`` (BOO04). Rows are summed by cluster first, so a draw costs a cluster, not a row."""
    sums = rows.groupBy(*within, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    each = sums.join(stats.draws(clusters, cluster, n, seed, "clusters"), cluster).groupBy(*within, "draw").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("mean"))
    return stats.interval(each, within, "mean")


@query(TRIPLES + " SELECT strict, exact, count(*) AS n, count(DISTINCT speaker) AS n_speakers, min(q) AS first FROM t GROUP BY 1, 2")
def qry18_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Where triples come from: whether the speaker's row is near in duration and the content's text the same, and of how many speakers (QRY18)."""
    return triples(spark, d).groupBy("strict", "exact").agg(F.count("*").alias("n"), F.countDistinct("speaker").alias("n_speakers"), F.min("q").alias("first"))


@query(PREFERENCES + DRAWS + """, sums AS (SELECT layer, speaker, sum(pref) AS s, count(*) AS n FROM p GROUP BY 1, 2), each AS (SELECT layer, draw, sum(s * times) / sum(n * times)::DOUBLE AS m FROM sums JOIN draws USING (speaker) GROUP BY 1, 2),
iv AS (SELECT layer, quantile_cont(m, 0.025) / 10 AS lo, quantile_cont(m, 0.975) / 10 AS hi FROM each GROUP BY 1),
a AS (SELECT layer, count(*) AS n, sum(pref) / (10.0::DOUBLE * count(*)) AS pc, avg(content_sim) AS cs, avg(speaker_sim) AS ss, count_if(pref = 5) AS n_ties FROM p GROUP BY 1)
SELECT layer::INT AS layer, n, round(pc, 6) AS p_content, round(cs, 6) AS content_sim, round(ss, 6) AS speaker_sim, n_ties, round(lo, 6) AS lo, round(hi, 6) AS hi, layer >= 0 AND coalesce((pc > 0.5) <> (lag(pc) OVER (PARTITION BY layer >= 0 ORDER BY layer) > 0.5), false) AS crossover FROM a JOIN iv USING (layer)""")
def qry30_controlled_matching(spark: SparkSession, d: str) -> DataFrame:
    """For each layer how often content wins over speaker, ties as halves, with an interval over speakers, and the layers where the winner changes (QRY30, MET10, MET11, BOO04)."""
    p = preferences(spark, d)
    whole = p.groupBy("layer").agg(F.count("*").alias("n"), (F.sum("pref") / (10.0 * F.count("*"))).alias("pc"), r6(F.avg("content_sim")).alias("content_sim"), r6(F.avg("speaker_sim")).alias("speaker_sim"), F.count_if(F.col("pref") == 5).alias("n_ties"))
    iv = cluster_bootstrap(p, ["layer"], "speaker", F.col("pref"), p).select("layer", r6(F.col("lo") / 10).alias("lo"), r6(F.col("hi") / 10).alias("hi"))
    before = F.lag("pc").over(Window.partitionBy(F.col("layer") >= 0).orderBy("layer"))  # a row for each layer
    crossover = (F.col("layer") >= 0) & F.coalesce((F.col("pc") > 0.5) != (before > 0.5), F.lit(False))
    return whole.withColumn("crossover", crossover).join(iv, "layer").select("layer", "n", r6("pc").alias("p_content"), "content_sim", "speaker_sim", "n_ties", "lo", "hi", "crossover")


@query(PREFERENCES + DRAWS + """, sums AS (SELECT layer, speaker, sum(pref) AS s, count(*) AS n FROM p WHERE strict GROUP BY 1, 2), each AS (SELECT layer, draw, sum(s * times) / sum(n * times)::DOUBLE AS m FROM sums JOIN draws USING (speaker) GROUP BY 1, 2),
iv AS (SELECT layer, quantile_cont(m, 0.025) / 10 AS lo, quantile_cont(m, 0.975) / 10 AS hi FROM each GROUP BY 1),
a AS (SELECT layer, sum(pref) / (10.0::DOUBLE * count(*)) AS all_, sum(pref) FILTER (WHERE strict) / (10.0::DOUBLE * nullif(count_if(strict), 0)) AS strict_, count_if(strict) AS n_strict FROM p GROUP BY 1)
SELECT layer::INT AS layer, n_strict, round(all_, 6) AS p_all, round(strict_, 6) AS p_strict, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > 0.5 OR hi < 0.5 AS decided, rank() OVER (ORDER BY round(all_, 9) DESC) = rank() OVER (ORDER BY round(strict_, 9) DESC) AS same_place FROM a LEFT JOIN iv USING (layer)""")
def qry37_strict_subset(spark: SparkSession, d: str) -> DataFrame:
    """Preferences over all triples and over those near in duration only, with an interval over speakers, and whether layers keep their places (QRY37, FLT14)."""
    p = preferences(spark, d)
    share = lambda c: F.sum(F.when(c, F.col("pref"))) / (10.0 * F.nullif(F.count_if(c), F.lit(0)))
    a = p.groupBy("layer").agg(share(F.lit(True)).alias("x"), share(F.col("strict")).alias("y"), F.count_if("strict").alias("n_strict"))
    iv = cluster_bootstrap(p.where("strict"), ["layer"], "speaker", F.col("pref"), p).select("layer", (F.col("lo") / 10).alias("lo"), (F.col("hi") / 10).alias("hi"))
    place = lambda c: F.rank().over(Window.orderBy(F.round(c, 9).desc()))  # noqa: E731  a row for each layer
    return a.join(iv, "layer", "left").select("layer", "n_strict", r6("x").alias("p_all"), r6("y").alias("p_strict"), r6("lo").alias("lo"), r6("hi").alias("hi"), ((F.col("lo") > 0.5) | (F.col("hi") < 0.5)).alias("decided"), (place("x") == place("y")).alias("same_place"))


VARIANT = TRIPLES + COUNTS + ", v AS (SELECT q, duration, a.layer, a.e, b.e AS f FROM t JOIN m ON m.i = q JOIN cut a ON a.i = q JOIN cut b ON b.i = content AND b.layer = a.layer)"


def _variants(spark: SparkSession, d: str) -> DataFrame:
    """q, duration, layer, e and f: the counts of each content's two texts."""
    m = texts(spark, d)
    counts = layered(m)
    pair = triples(spark, d).select("q", "content").join(m.select(F.col("utt_id").alias("q"), "duration"), "q")
    both = pair.join(counts.toDF("q", "e"), "q").join(counts.toDF("content", "f"), "content")
    return both.select("q", "duration", F.posexplode(F.arrays_zip("e", "f")).alias("at", "x")).select("q", "duration", F.when(F.col("at") == LAYERS, UNIFORM).otherwise(F.col("at")).alias("layer"), "x.e", "x.f")


@query(VARIANT + ", c AS (SELECT layer, list_aggregate(list_transform(list_zip(e, f), lambda z: abs(z[1] - z[2])), 'max') AS diff FROM v) SELECT layer::INT AS layer, count(*) AS n, count_if(diff > 0) AS n_differing, max(diff) AS max_abs_diff, count_if(diff > 0) = 0 AS identical FROM c GROUP BY 1")
def vec15_variant_difference(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of each content's two texts against each other, layer by layer: how many differ and how far (VEC15, QRY41, API09)."""
    diff = F.array_max(F.zip_with("e", "f", lambda x, y: F.abs(x - y)))
    return _variants(spark, d).select("layer", diff.alias("diff")).groupBy("layer").agg(F.count("*").alias("n"), F.count_if(F.col("diff") > 0).alias("n_differing"), F.max("diff").alias("max_abs_diff"), (F.count_if(F.col("diff") > 0) == 0).alias("identical"))


@query(VARIANT + """, s AS (SELECT layer, CASE WHEN duration < 1000 THEN 'short' ELSE 'long' END AS bucket, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS ne, sqrt(list_sum(list_transform(f, lambda x: x * x))) AS nf, list_inner_product(e, f) AS ef, sqrt(list_sum(list_transform(list_zip(e, f), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM v)
SELECT layer::INT AS layer, bucket, count(*) AS n, round(avg(ef / nullif(ne * nf, 0)), 6) AS mean_cos, round(min(ef / nullif(ne * nf, 0)), 6) AS least_cos, round(max(d / nullif(ne, 0)), 6) AS max_rel FROM s GROUP BY 1, 2""")
def qry40_padding(spark: SparkSession, d: str) -> DataFrame:
    """How far a content's vectors agree between its two texts, by layer and by short and long rows: cosine and relative error (QRY40, VEC13)."""
    gap = F.sqrt(V.total(F.zip_with("e", "f", lambda x, y: (x - y) * (x - y))))
    cos = V.dot(F.col("e"), F.col("f")) / F.nullif(V.norm(F.col("e")) * V.norm(F.col("f")), F.lit(0.0))
    s = _variants(spark, d).select("layer", F.when(F.col("duration") < 1000, "short").otherwise("long").alias("bucket"), cos.alias("cos"), (gap / F.nullif(V.norm(F.col("e")), F.lit(0.0))).alias("rel"))
    return s.groupBy("layer", "bucket").agg(F.count("*").alias("n"), r6(F.avg("cos")).alias("mean_cos"), r6(F.min("cos")).alias("least_cos"), r6(F.max("rel")).alias("max_rel"))


TRANSFER = TEXTS.rstrip(", ") + COUNTS + ", z AS (SELECT lay.*, h, CASE WHEN dataset = 'en' THEN 'first' ELSE 'second' END AS corpus FROM lay JOIN m USING (i) JOIN manifest ON utt_id = i)" + """,
one AS (SELECT a.corpus, a.layer, a.i, a.h, (a.h = b.h)::INT AS hit FROM z a JOIN z b ON a.corpus = b.corpus AND a.layer = b.layer AND a.i <> b.i QUALIFY row_number() OVER (PARTITION BY a.layer, a.i ORDER BY round(list_inner_product(a.vec, b.vec), 12) DESC, b.i) = 1),
sc AS (SELECT corpus, layer, sum(hit) AS hits, count(*) AS n FROM one GROUP BY 1, 2), pick AS (SELECT layer FROM sc WHERE corpus = 'first' AND layer >= 0 ORDER BY hits DESC, layer LIMIT 1),
g AS (SELECT h AS speaker, sum(hit * (layer = (SELECT layer FROM pick))::INT) AS s, sum(hit * (layer = 7)::INT) AS f, sum(hit * (layer = -1)::INT) AS u, count(*) FILTER (WHERE layer = 7) AS n FROM one WHERE corpus = 'second' GROUP BY 1)"""


@query(TRANSFER + ", " + stats.draws_sql("g", "speaker", CLUSTER_DRAWS, 47, "second").replace("{", "{{").replace("}", "}}") + """, each AS (SELECT draw, sum((s - f) * times) / sum(n * times)::DOUBLE AS a, sum((s - u) * times) / sum(n * times)::DOUBLE AS b FROM g JOIN draws USING (speaker) GROUP BY 1)
SELECT (SELECT layer FROM pick)::INT AS picked_layer, (SELECT layer FROM sc WHERE corpus = 'second' AND layer >= 0 ORDER BY hits DESC, layer LIMIT 1)::INT AS best_second_layer, sum(n)::BIGINT AS n, count(*) AS n_speakers, round(sum(s) / sum(n)::DOUBLE, 6) AS selected, round(sum(f) / sum(n)::DOUBLE, 6) AS final, round(sum(u) / sum(n)::DOUBLE, 6) AS uniform,
round(sum(s - f) / sum(n)::DOUBLE, 6) AS gain_vs_final, (SELECT round(quantile_cont(a, 0.025), 6) FROM each) AS final_lo, (SELECT round(quantile_cont(a, 0.975), 6) FROM each) AS final_hi, round(sum(s - u) / sum(n)::DOUBLE, 6) AS gain_vs_uniform, (SELECT round(quantile_cont(b, 0.025), 6) FROM each) AS uniform_lo, (SELECT round(quantile_cont(b, 0.975), 6) FROM each) AS uniform_hi FROM g""")
def qry34_second_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The layer that finds speakers best in one corpus (English texts), carried to another with speakers' labels of its own: its gain there, paired by row, with an interval over samples of whole speakers (QRY34)."""
    m = texts(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("utt_id"), (F.col("lang") == "en").alias("first")), "utt_id")
    vecs = layered(m).select("utt_id", F.flatten(F.transform("counts", lambda v: V.unit(v))).alias("vec"))
    v = m.select("utt_id", "speaker_id", F.coalesce("first", F.lit(False)).alias("first")).join(vecs, "utt_id").select(F.col("utt_id").alias("id"), F.crc32(F.col("speaker_id").cast("binary")).alias("label"), "speaker_id", "first", "vec")
    v = written(v)
    hits = lambda rows: retrieval.layer_hits(rows, LAYERS + 1)
    best = lambda h: h.where(F.col("layer") < LAYERS).groupBy("layer").agg(F.sum("hit").alias("s")).agg(F.max(F.struct("s", F.negative("layer").alias("o"))).alias("x")).first().x
    picked = best(hits(v.where("first")))
    second = written(hits(v.where("NOT first"))).join(v.select(F.col("id").alias("qid"), F.col("speaker_id").alias("speaker")), "qid")
    there = best(second)
    at = lambda k: F.sum(F.when(F.col("layer") == F.lit(k), F.col("hit")).otherwise(0))
    g = second.groupBy("speaker").agg(at(None if picked is None else -picked.o).alias("s"), at(LAYERS - 1).alias("f"), at(LAYERS).alias("u"), F.count_if(F.col("layer") == LAYERS - 1).alias("n"))
    gain = lambda c: F.sum((F.col("s") - F.col(c)) * F.col("times")) / F.sum(F.col("n") * F.col("times"))
    each = g.join(stats.draws(g, "speaker", CLUSTER_DRAWS, 47, "second"), "speaker").groupBy("draw").agg(gain("f").alias("a"), gain("u").alias("b"))
    ends = each.agg(*[r6(F.percentile(c, p)).alias(n) for c, p, n in (("a", 0.025, "final_lo"), ("a", 0.975, "final_hi"), ("b", 0.025, "uniform_lo"), ("b", 0.975, "uniform_hi"))])
    of = lambda x: r6(F.sum(x) / F.sum("n"))
    row = g.agg(F.sum("n").alias("n"), F.count("*").alias("n_speakers"), of("s").alias("selected"), of("f").alias("final"), of("u").alias("uniform"), of(F.col("s") - F.col("f")).alias("gain_vs_final"), of(F.col("s") - F.col("u")).alias("gain_vs_uniform"))
    names = [F.lit(None if x is None else -x.o).cast("int").alias(n) for x, n in ((picked, "picked_layer"), (there, "best_second_layer"))]
    return row.crossJoin(ends).select(*names, "n", "n_speakers", "selected", "final", "uniform", "gain_vs_final", "final_lo", "final_hi", "gain_vs_uniform", "uniform_lo", "uniform_hi")
