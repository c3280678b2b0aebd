"""How filters overlap: every order of a few filters is run as a path of a trie, and each step's removals are counted.

The trie of all orders has a path for each permutation, but what is left after a prefix doesn't depend
on its order. So the walk goes depth first from the rows that nothing has been removed from, applies one
more filter to the persisted survivors of the state above, counts there what each filter that is still to
come would remove, and remembers the counts of each unordered prefix: 2^n states are computed for n! orders.
A state's rows are given back as soon as the walk has left it, so n + 1 of them are persisted at most.

Survivors are narrow: the part, a flag for each filter and the two labels. They are cut from the texts by a
table in the shared folder, from which a lost executor's share is computed again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import kept

#: There are n! orders.
MOST = 7
#: Texts that occur more than once are sent to all tasks up to this many (32 bytes each and an id).
FEW = 500_000
WORD = r"[^\x20\x09-\x0D]+"


def text_filters(text: str = "text") -> dict[str, Column]:
    """The conditions on which documents fail: too few words (A), too few distinct ones (B), capitals (C), symbols (D), a text that a smaller doc_id has (E)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": F.col(text).rlike(r"[#$%&*|]"),
        "E": F.col("__again"),
    }


def repeated(docs: DataFrame) -> DataFrame:
    """Adds __again to rows of doc_id and text: whether a smaller doc_id has the same text. Null ids are never told apart: they repeat nothing and nothing repeats them."""
    rows = docs.withColumn("__digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    first = kept(rows.where("doc_id IS NOT NULL").groupBy("__digest").agg(F.min("doc_id").alias("__first"), F.max("doc_id").alias("__last")).where("__first < __last").select("__digest", "__first"))
    first = F.broadcast(first) if first.count() <= FEW else first
    return rows.join(first, "__digest", "left").withColumn("__again", F.coalesce(F.col("doc_id") > F.col("__first"), F.lit(False)))


def flags(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, fails_A .. fails_E, good and toxic of each row; the only table for which texts are read.

    Null texts are empty ones and have no words, null parts the empty one. A document is good (toxic) if
    any of its label rows says so; labels without an id are left out. Repeated rows count each.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("__part"))
    marks = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("__good"), F.max((F.col("toxic") == 1).cast("int")).alias("__toxic"))
    found = kept(repeated(rows).select("doc_id", F.col("__part").alias("part"), *[F.coalesce(e, F.lit(False)).alias(f"fails_{k}") for k, e in text_filters().items()]))
    if dict(docs.dtypes)["doc_id"] != dict(labels.dtypes)["doc_id"]:
        found, marks = (x.withColumn("doc_id", F.col("doc_id").cast("string")) for x in (found, marks))
    return found.join(marks, "doc_id", "left").select("part", *[f"fails_{k}" for k in text_filters()], (F.coalesce("__good", F.lit(0)) == 1).alias("good"), (F.coalesce("__toxic", F.lit(0)) == 1).alias("toxic"))


def _counts(rows: DataFrame, done: frozenset[str], names: list[str]) -> DataFrame:
    """For each part and filter to come: how many survivors there are, how many of them it removes, and how many of those are good or toxic."""
    to_come = [f for f in names if f not in done]
    sums = [F.count_if(F.col(f"fails_{f}") & more).alias(f"{f}_{what}") for f in to_come for what, more in (("removed", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))]
    edges = F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f"{f}_removed").alias("removed"), F.col(f"{f}_good").alias("good_lost"), F.col(f"{f}_toxic").alias("toxic_lost")) for f in to_come])
    return rows.groupBy("part").agg(F.count("*").alias("before"), *sums).select(F.lit("".join(sorted(done))).alias("state"), "part", "before", F.inline(edges))


def walk(rows: DataFrame, names: list[str]) -> DataFrame:
    """state (the filters applied, sorted), part, before, filter, removed, good_lost, toxic_lost for each edge of the trie, each unordered prefix once."""
    memo: dict[frozenset[str], DataFrame] = {}

    def visit(survivors: DataFrame, done: frozenset[str]) -> None:
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            memo[done] = kept(_counts(survivors, done, names).coalesce(1))
            for f in names:
                after = done | {f}
                if f not in done and after not in memo and len(after) < len(names):
                    visit(survivors.where(~F.col(f"fails_{f}")), after)
        finally:
            survivors.unpersist()

    visit(rows, frozenset())
    return reduce(DataFrame.unionByName, memo.values())


def steps(names: list[str]) -> Iterator[tuple[str, int, str, str]]:
    """Every order, its steps, each step's filter and the state that it meets."""
    for order in permutations(names):
        for i, f in enumerate(order):
            yield "".join(order), i + 1, f, "".join(sorted(order[:i]))


def audit(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows: part, a boolean fails_<name> for each filter (names of one letter), good and toxic.

    One row for each part, order of all filters and step, zeros included: kept after the step, removed by it,
    redundant (failing its filter, but removed earlier), unique_fails (failing its filter only), good_lost and toxic_lost
    (removed by it), and shapley, the filter's removals summed over all orders. Null flags are false; a null part is one of its own.
    An empty table has no parts and no rows. Rows are never sent anywhere but to partial sums of their part.
    """
    if not 1 <= len(names) <= MOST or any(len(f) != 1 for f in names) or len(set(names)) < len(names):
        raise ValueError(f"1 to {MOST} filters with names of one letter each")
    spark = rows.sparkSession
    rows = kept(rows.select("part", *[F.coalesce(c, F.lit(False)).alias(c) for c in (*[f"fails_{f}" for f in names], "good", "toxic")]))
    edges = kept(walk(rows, names))
    alone = reduce(lambda a, b: a + b, [F.col(f"fails_{f}").cast("int") for f in names]) == 1
    per = rows.groupBy("part").agg(*[F.count_if(F.col(f"fails_{f}")).alias(f"{f}_all") for f in names], *[F.count_if(F.col(f"fails_{f}") & alone).alias(f"{f}_only") for f in names])
    per = per.select("part", F.inline(F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f"{f}_all").alias("fails"), F.col(f"{f}_only").alias("unique_fails")) for f in names])))
    # how many orders reach an edge: those of the filters before it times those of the filters after it
    n = len(names)
    paths = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.length("state") + 1)
    totals = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * paths).alias("shapley"))
    same = lambda *names: reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names])
    per = per.alias("l").join(totals.alias("r"), same("part", "filter")).select("l.*", "shapley")
    # n * n! rows: at most 35,280
    trie = F.broadcast(spark.createDataFrame(list(steps(names)), "filter_order string, step int, filter string, state string"))
    # a part of which a state has nothing left has no counts there
    had = lambda c: F.coalesce(f"r.{c}", F.lit(0))
    return per.join(trie, "filter").alias("l").join(edges.alias("r"), same("part", "state", "filter"), "left").select(
        "l.part", "filter_order", "step",
        (had("before") - had("removed")).alias("kept"), had("removed").alias("removed"), (F.col("fails") - had("removed")).alias("redundant"),
        "unique_fails", had("good_lost").alias("good_lost"), had("toxic_lost").alias("toxic_lost"), "shapley",
    )


def audit_sql() -> str:
    """The audit of ``text_filters`` by source in DuckDB, from the flags alone: no state is shared there."""
    words = "regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, {words} AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
marks AS (SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
 + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS bits FROM texts LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS path FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, path[step] AS bit, list_sum(path[:step - 1])::INT AS before FROM orders, range(1, 6) t(step)),
edges AS (SELECT DISTINCT bit, coalesce(before, 0) AS before FROM steps),
counted AS (SELECT part, bit, before, coalesce(sum(n) FILTER (bits & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (bits & before = 0 AND bits & bit > 0), 0) AS removed,
 coalesce(sum(n) FILTER (bits & before > 0 AND bits & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (bits = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (bits & before = 0 AND bits & bit > 0), 0) AS good_lost,
 coalesce(sum(toxic) FILTER (bits & before = 0 AND bits & bit > 0), 0) AS toxic_lost FROM cells, edges GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM steps JOIN counted USING (bit) WHERE counted.before = coalesce(steps.before, 0)"""
