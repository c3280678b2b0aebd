"""Building evaluation sets (SMP): caps, splits, pairs and groups, each choice a keyed hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import keyed


def normal_text(text: Column) -> Column:
    """Runs of blanks as one space, none at the ends; empty for null."""
    # a single space stays as it is, so that only the other blanks are matched and copied
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s{2,}|[\t\n\x0B\f\r]", " "))


def content_groups(rows: DataFrame, text: str, holder: str, least: int = 2) -> DataFrame:
    """norm, n_rows, n_holders of texts that at least ``least`` holders share."""
    found = rows.select(normal_text(F.col(text)).alias("norm"), holder).where(F.length("norm") > 0).groupBy("norm").agg(F.count("*").alias("n_rows"), F.countDistinct(holder).alias("n_holders"))
    return found.where(F.col("n_holders") >= least)


def capped(rows: DataFrame, within: Sequence[str], ident: str, most: int, least: int = 1, seed: int = 13) -> DataFrame:
    """At most ``most`` rows of each group with at least ``least`` rows, by keyed order."""
    w = Window.partitionBy(*within)
    ranked = rows.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__r", F.row_number().over(w.orderBy(keyed(seed, "cap", ident), ident)))
    return ranked.where((F.col("__n") >= least) & (F.col("__r") <= most)).drop("__n", "__r")


def split(rows: DataFrame, within: Sequence[str], ident: str, share: float = 0.25, seed: int = 13) -> DataFrame:
    """Adds split: of each group max(1, round(n * share)) rows are "test", the others "train"; groups that would have no train rows go."""
    w = Window.partitionBy(*within)
    n = F.greatest(F.lit(1), F.bround(F.count(F.lit(1)).over(w) * share).cast("int"))
    ranked = rows.withColumn("__t", n).withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__r", F.row_number().over(w.orderBy(keyed(seed, "split", ident), ident)))
    return ranked.where(F.col("__n") > F.col("__t")).withColumn("split", F.when(F.col("__r") <= F.col("__t"), "test").otherwise("train")).drop("__t", "__n", "__r")


def verification_pairs(rows: DataFrame, holder: str, ident: str, n: int, seed: int = 13, probes: int = 8) -> DataFrame:
    """id_a < id_b, label: n / 2 pairs of one holder and n / 2 of two, by keyed order.

    Candidates are neighbours at distance 1 to ``probes`` in a keyed order, within holders for
    positives and over all rows for negatives, so their number is linear in the rows.
    """
    within = Window.partitionBy(holder).orderBy(keyed(seed, "pos", ident), ident)
    spread = Window.partitionBy(keyed(seed, "cell", ident) % 64).orderBy(keyed(seed, "neg", ident), ident)

    def near(w: object, label: int) -> DataFrame:
        lagged = F.array(*[F.struct(F.lag(ident, j).over(w).alias("o"), F.lag(holder, j).over(w).alias("h")) for j in range(1, probes + 1)])
        pairs = rows.withColumn("__near", lagged).select(ident, holder, F.explode("__near").alias("x")).where(F.col("x.o").isNotNull() & ((F.col("x.h") == F.col(holder)) if label else (F.col("x.h") != F.col(holder))))
        pairs = pairs.select(F.least(ident, "x.o").alias("id_a"), F.greatest(ident, "x.o").alias("id_b")).distinct()
        return pairs.orderBy(keyed(seed, f"pair{label}", "id_a", "id_b"), "id_a", "id_b").limit(n // 2).withColumn("label", F.lit(label))

    return near(within, 1).unionByName(near(spread, 0))


def drawn_pairs(rows: DataFrame, holder: str, ident: str, n: int, seed: int = 42) -> DataFrame:
    """id_a < id_b, label: n / 2 pairs of one holder and n / 2 of two, holders drawn uniformly, then their rows.

    Draws are numbered and keyed; of repeated pairs the first counts. Holders with one row take no part.
    Where there are fewer different pairs, all are drawn.
    """
    w = Window.partitionBy(holder)
    held = rows.withColumn("__i", F.row_number().over(w.orderBy(ident)) - 1).withColumn("__n", F.count(F.lit(1)).over(w)).where("__n >= 2")
    sizes = held.groupBy(holder).agg(F.count("*").alias("__n")).withColumn("__s", F.row_number().over(Window.orderBy(holder)) - 1)
    total = sizes.agg(F.count("*").alias("k"), F.sum("__n").alias("m"), F.sum(F.col("__n") * (F.col("__n") - 1) / 2).alias("same"), F.sum(F.col("__n") * F.col("__n")).alias("squares")).first()
    if total.k < 2:
        raise ValueError("need two holders with two rows each")
    place = held.join(sizes.select(holder, "__s"), holder).select("__s", "__i", ident)
    size = sizes.select("__s", "__n")

    def side(x: str) -> DataFrame:
        return place.select(F.col("__s").alias(f"__s{x}"), F.col("__i").alias(f"__i{x}"), F.col(ident).alias(f"__{x}"))

    def draws(label: int, of: DataFrame) -> DataFrame:
        key = lambda salt: keyed(seed, f"{salt}{label}", "id")
        d = of.withColumn("__sa", key("holder") % total.k)
        d = d.withColumn("__sb", F.col("__sa") if label else (F.col("__sa") + 1 + key("other") % (total.k - 1)) % total.k)
        for x in "ab":
            d = d.join(size.select(F.col("__s").alias(f"__s{x}"), F.col("__n").alias(f"__n{x}")), f"__s{x}")
        d = d.withColumn("__ia", key("first") % F.col("__na"))
        d = d.withColumn("__ib", (F.col("__ia") + 1 + key("second") % (F.col("__na") - 1)) % F.col("__na") if label else key("second") % F.col("__nb"))
        for x in "ab":
            d = d.join(side(x), [f"__s{x}", f"__i{x}"])
        return d.select("id", F.least("__a", "__b").alias("id_a"), F.greatest("__a", "__b").alias("id_b")).groupBy("id_a", "id_b").agg(F.min("id").alias("id"))

    def some(label: int, possible: int) -> DataFrame:
        wanted = min(n // 2, possible)
        many = 2 * wanted
        while True:
            found = draws(label, rows.sparkSession.range(many)).cache()
            if found.count() >= wanted:
                return found.orderBy("id").limit(wanted).select("id_a", "id_b", F.lit(label).alias("label"))
            found.unpersist()
            many *= 2

    return some(1, int(total.same)).unionByName(some(0, int((total.m**2 - total.squares) // 2)))


def next_other(rows: DataFrame, within: str, differs: str, ident: str, salt: str, seed: int = 13) -> DataFrame:
    """Adds other: the next row of the same ``within`` with another value of ``differs``, in a keyed order that closes in a ring; null without one.

    One sort of each group and no pairs: the next row is where the next run of equal values begins.
    """
    w = Window.partitionBy(within)
    ahead, back = (keyed(seed, salt, ident), F.col(ident)), (F.desc(keyed(seed, salt, ident)), F.desc(ident))
    same = F.lag(differs).over(w.orderBy(*ahead)).eqNullSafe(F.col(differs)) & (F.row_number().over(w.orderBy(*ahead)) > 1)
    runs = rows.withColumn("__i", F.row_number().over(w.orderBy(*ahead))).withColumn("__begins", ~same)
    later = F.last(F.when(F.col("__begins"), F.col(ident)), ignorenulls=True).over(w.orderBy(*back).rowsBetween(Window.unboundedPreceding, -1))
    head = F.min_by(F.struct(F.col(ident).alias("x"), F.col(differs).alias("v")), "__i").over(w)
    second = F.min_by(F.when(F.col("__begins"), F.col(ident)), F.when(F.col("__begins") & (F.col("__i") > 1), F.col("__i"))).over(w)
    found = runs.withColumn("__later", later).withColumn("__head", head).withColumn("__second", second)
    ring = F.when(~F.col("__head.v").eqNullSafe(F.col(differs)), F.col("__head.x")).otherwise(F.col("__second"))
    return found.withColumn("other", F.coalesce("__later", ring)).drop("__i", "__begins", "__later", "__head", "__second")


def _numbered(rows: DataFrame, bucket: Column, order: str, name: str) -> DataFrame:
    """Adds ``name``: places from 0 by bucket, then by ``order``, without a sort of all rows in one task; buckets are 4,096 at most."""
    rows = rows.withColumn("__b", bucket)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("__b", "__start")
    place = F.row_number().over(Window.partitionBy("__b").orderBy(order)) - 1
    return rows.withColumn("__r", place).join(F.broadcast(starts), "__b").withColumn(name, F.col("__start") + F.col("__r")).drop("__b", "__r", "__start")


def content_pairs(rows: DataFrame, content: str, holder: str, ident: str, n: int, tries: int = 16, seed: int = 13) -> DataFrame:
    """i, id_a <= id_b, label: of ``tries`` * n numbered draws the first n / 2 valid ones of each label; pairs may repeat.

    Label 1: a content uniformly among those (hexadecimal digests) of two holders, then two rows of it by two holders.
    Label 0: two rows of such contents with other contents and holders. Fewer come out where valid draws are fewer.
    """
    groups = rows.groupBy(content).agg(F.count("*").alias("__n"), F.countDistinct(holder).alias("__h")).where("__h >= 2").drop("__h")
    groups = _numbered(groups, F.conv(F.substring(content, 1, 3), 16, 10).cast("int"), content, "__g")
    held = rows.join(groups, content).withColumn("__j", F.row_number().over(Window.partitionBy(content).orderBy(ident)) - 1)
    whole = _numbered(held, (keyed(seed, "row", ident) % 4096).cast("int"), ident, "__w")
    n_groups, n_rows = groups.agg(F.count("*").alias("__m")), held.agg(F.count("*").alias("__t"))
    draws = rows.sparkSession.range(tries * n).withColumnRenamed("id", "i")
    key = lambda salt: keyed(seed, salt, "i")

    def side(of: DataFrame, places: tuple[str, ...], x: str) -> DataFrame:
        return of.select(*[F.col(p).alias(f"{p}{x}") for p in places], F.col(ident).alias(f"__id{x}"), F.col(holder).alias(f"__h{x}"), F.col("__g").alias(f"__of{x}"))

    def first(valid: DataFrame, label: int) -> DataFrame:
        return valid.orderBy("i").limit(n // 2).select("i", F.least("__ida", "__idb").alias("id_a"), F.greatest("__ida", "__idb").alias("id_b"), F.lit(label).alias("label"))

    one = draws.crossJoin(F.broadcast(n_groups)).withColumn("__g", key("group") % F.col("__m")).join(groups.select("__g", "__n"), "__g")
    one = one.select("i", F.col("__g").alias("__ga"), F.col("__g").alias("__gb"), (key("a") % F.col("__n")).alias("__ja"), "__n")
    one = one.withColumn("__jb", (F.col("__ja") + 1 + key("b") % (F.col("__n") - 1)) % F.col("__n"))
    two = draws.crossJoin(F.broadcast(n_rows)).select("i", (key("x") % F.col("__t")).alias("__wa"), (key("y") % F.col("__t")).alias("__wb"))
    for x in "ab":
        one = one.join(side(held, ("__g", "__j"), x), [f"__g{x}", f"__j{x}"])
        two = two.join(side(whole, ("__w",), x), f"__w{x}")
    return first(one.where("__ha <> __hb"), 1).unionByName(first(two.where("__ofa <> __ofb AND __ha <> __hb"), 0))
