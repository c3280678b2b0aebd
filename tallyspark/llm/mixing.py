"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A tree of levels (such as domain, language, source) has a weight at every node. The token budget
goes down from the root: siblings share their parent's budget by weight, none gets more than its
subtree can give (tokens times epochs), and what one can't take goes to its siblings by weight; so
a shortage is made up as far down the tree as it can be, and only what a whole subtree lacks is left
to the siblings of an ancestor. Each leaf then takes whole epochs of its documents and, of one more
epoch, a prefix in that epoch's own seeded order: the documents whose tokens end within what is left.

No task gets a whole leaf: documents are dealt into ``BUCKETS`` ranges of their seeded hash, summed
by leaf and range, and only the one range of each leaf that holds the cut is ordered by document.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import kept

BUCKETS = 4096
#: Leaves of the tree up to which the cuts are broadcast.
LEAVES = 100_000


def words(text: str = "text") -> Column:
    """Runs without blanks; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded(seed: int, columns: Sequence[str]) -> Column:
    """The first 60 bits of md5 over the seed and all columns as text: an order that any engine with md5 can repeat."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def of_epoch(h: Column, epoch: Column) -> Column:
    """A row's place in the order of an epoch, from its seeded hash: every epoch has another order."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", h.cast("string"), epoch.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def _key(levels: list[str], depth: int) -> Column:
    return F.to_json(F.array(*[F.col(c) for c in levels[:depth]])) if depth else F.lit("[]")


def budgets(leaves: DataFrame, levels: list[str], budget: float | None, share: float = 1.0, epochs: int = 1) -> DataFrame:
    """leaves: ``levels``, tokens, and w1 .. wn, the weight of the leaf's ancestor (or itself) at each level.

    Adds supply (tokens * epochs), target (the budget split by weights alone) and take (at most the
    supply). The total is ``budget``, or ``share`` of all supply; beyond the supply of nodes with a
    weight above 0 nothing can be taken. Siblings are as many as the tree has, not as many as rows.
    """
    rows = leaves.withColumn("supply", (F.col("tokens") * epochs).cast("double"))
    n = len(levels)
    for c in range(1, n + 1):
        rows = rows.withColumn(f"w{c}", F.greatest(F.coalesce(F.col(f"w{c}"), F.lit(0.0)).cast("double"), F.lit(0.0)))
    # a node without weight can give nothing
    rows = rows.withColumn("gives", F.when(reduce(lambda a, b: a & b, [F.col(f"w{c}") > 0 for c in range(1, n + 1)]), F.col("supply")).otherwise(0.0))
    total = rows.agg(F.coalesce(F.sum("gives"), F.lit(0.0)).alias("cap0"), F.coalesce(F.sum("supply"), F.lit(0.0)).alias("all0"))
    want = F.lit(float(budget)) if budget is not None else F.col("all0") * share
    rows = rows.crossJoin(F.broadcast(total.select(want.alias("target0"), F.least(want, F.col("cap0")).alias("take0")))).withColumn("k0", F.lit("[]"))
    for d in range(1, n + 1):
        rows = rows.withColumn(f"k{d}", _key(levels, d))
        nodes = rows.groupBy(f"k{d - 1}", f"k{d}").agg(F.sum("gives").alias("cap"), F.max(f"w{d}").alias("w"), F.max(f"take{d - 1}").alias("of"), F.max(f"target{d - 1}").alias("goal"))
        kin = Window.partitionBy(f"k{d - 1}")
        order = kin.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(0.0), f"k{d}")
        upto = order.rowsBetween(Window.unboundedPreceding, -1)
        nodes = (
            nodes.withColumn("full", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
            .withColumn("rest", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
            .withColumn("level", F.when(F.col("rest") > 0, (F.col("of") - F.col("full")) / F.col("rest")).otherwise(0.0))
            # in order of supply for the weight, the first that isn't used up fixes the level for all after it
            .withColumn("open", F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level")))
            .withColumn("level", F.min(F.struct(F.when(F.col("open").isNull(), 1).otherwise(0), F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(0.0), F.col(f"k{d}"), "open")).over(kin)["open"])
            .withColumn(f"take{d}", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))))
            .withColumn("weights", F.sum("w").over(kin))
            .withColumn(f"target{d}", F.when(F.col("weights") > 0, F.col("goal") * F.col("w") / F.col("weights")).otherwise(0.0))
            .select(f"k{d}", f"take{d}", f"target{d}")
        )
        rows = rows.join(nodes, f"k{d}")
    return rows.select(*levels, "tokens", "supply", F.col(f"target{n}").alias("target"), F.col(f"take{n}").alias("take"))


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, Column], budget: float | None = None, share: float = 1.0, epochs: int = 1, seed: int = 17, tokens: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their own columns, and mix_tokens and mix_copies.

    levels: name and expression of each level of the tree, from the top; weights: of each level's
    nodes, an expression on the level columns (``mix_<name>``). Nulls in a level are a node of their
    own, "(none)". Documents without tokens are never taken, as they bring none. Repeated rows count each;
    ties in the seeded order are broken by a hash of the whole row, and rows that are wholly equal
    are taken or left together. mix_copies is how often the document is in the mix: whole
    epochs, and one more for the prefix. Columns of ``docs`` that begin with "mix_" or "__" clash and are refused.
    """
    if clash := [c for c in docs.columns if c.startswith(("mix_", "__"))]:
        raise ValueError(f"columns of docs clash with the mix's own: {clash}")
    names, own = [f"mix_{k}" for k in levels], docs.columns
    rows = docs.select("*", *[F.coalesce(e.cast("string"), F.lit("(none)")).alias(f"mix_{k}") for k, e in levels.items()], (words() if tokens is None else tokens).alias("mix_tokens")).where(F.col("mix_tokens") > 0)
    rows = rows.withColumn("__h", seeded(seed, own))
    # texts are read once for these narrow rows and once more for the result; all between works on narrow rows
    narrow = kept(rows.select(*names, "__h", "mix_tokens"))
    leaves = narrow.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens")).select("*", *[w.cast("double").alias(f"w{i}") for i, w in enumerate(weights.values(), 1)])
    cuts = budgets(leaves, names, budget, share, epochs).select(
        *names,
        F.when(F.col("take") >= F.col("supply"), F.lit(epochs)).otherwise(F.floor(F.col("take") / F.col("tokens"))).cast("int").alias("__whole"),
        F.when(F.col("take") >= F.col("supply"), F.lit(0.0)).otherwise(F.col("take") - F.floor(F.col("take") / F.col("tokens")) * F.col("tokens")).alias("__left"),
    )
    # a row for each leaf: sent to all tasks if they are few, else joined by shuffle
    cuts = kept(cuts)
    few = cuts.count() <= LEAVES
    sent = lambda leaf: F.broadcast(leaf) if few else leaf
    place = of_epoch(F.col("__h"), F.col("__whole"))
    dealt = narrow.join(sent(cuts), names).withColumn("__e", place).withColumn("__b", F.shiftright("__e", 61 - BUCKETS.bit_length()))
    cells = dealt.groupBy(*names, "__b").agg(F.sum("mix_tokens").alias("tokens"))
    before = Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("__before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).join(cuts, names)
    # of each leaf, the range that holds the cut: ranges before it are in whole, those after it out
    cut = placed.where((F.col("__before") <= F.col("__left")) & (F.col("__before") + F.col("tokens") > F.col("__left"))).select(*names, F.col("__b").alias("__cut"), F.col("__before").alias("__at"), "__left", "__whole")
    cut = kept(cut)
    inside = Window.partitionBy(*names).orderBy("__e")
    edge = dealt.drop("__left", "__whole").join(sent(cut), names).where(F.col("__b") == F.col("__cut")).withColumn("__upto", F.col("__at") + F.sum("mix_tokens").over(inside))
    last = edge.where(F.col("__upto") <= F.col("__left")).groupBy(*names).agg(F.max("__e").alias("__last"))
    # the last place of a leaf's prefix decides each row on its own, so no text is shuffled
    cut = kept(cut.join(last, names, "left").select(*names, "__whole", F.coalesce("__last", F.shiftleft("__cut", 61 - BUCKETS.bit_length()) - 1).alias("__last")))
    out = rows.join(sent(cut), names).withColumn("mix_copies", F.col("__whole") + (place <= F.col("__last")).cast("int"))
    return out.where(F.col("mix_copies") > 0).select(*own, *names, "mix_tokens", "mix_copies")


def mix_sql(columns: Sequence[str], levels: dict[str, str], weights: dict[str, str], share: float, epochs: int, seed: int = 17, table: str = "documents") -> str:
    """The same mix in DuckDB: common tables, the last of which, ``mixed``, has ``columns``, mix_<level>, mix_tokens and mix_copies."""
    names = [f"mix_{k}" for k in levels]
    leaf, n = ", ".join(names), len(names)
    key = lambda d: f"to_json([{', '.join(names[:d])}])::VARCHAR" if d else "'[]'"
    text = ", ".join(f"coalesce({c}::VARCHAR, chr(30))" for c in columns)
    out = [
        f"""dealt AS (SELECT *, {", ".join(f"coalesce(({e})::VARCHAR, '(none)') AS mix_{k}" for k, e in levels.items())}, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS mix_tokens,
('0x' || substr(md5(concat_ws(chr(31), '{seed}', {text})), 1, 15))::BIGINT AS h FROM {table})""",
        f"leaves AS (SELECT {leaf}, sum(mix_tokens)::DOUBLE AS tokens FROM dealt WHERE mix_tokens > 0 GROUP BY ALL)",
        f"weighed AS (SELECT *, tokens * {epochs} AS supply, {', '.join(f'greatest(coalesce(({w})::DOUBLE, 0), 0) AS w{d}' for d, w in enumerate(weights.values(), 1))} FROM leaves)",
        f"r0 AS (SELECT *, CASE WHEN {' AND '.join(f'w{d} > 0' for d in range(1, n + 1))} THEN supply ELSE 0 END AS gives, sum(supply) OVER () * {share}::DOUBLE AS target0, least(target0, sum(gives) OVER ()) AS take0, {', '.join(f'{key(d)} AS k{d}' for d in range(n + 1))} FROM weighed)",
    ]
    for d in range(1, n + 1):
        out += [
            f"g{d} AS (SELECT k{d - 1} AS up, k{d} AS k, sum(gives) AS cap, max(w{d}) AS w, max(take{d - 1}) AS whole, max(target{d - 1}) AS goal FROM r{d - 1} GROUP BY ALL)",
            f"o{d} AS (SELECT *, CASE WHEN w > 0 THEN cap / w ELSE 0 END AS ratio, row_number() OVER (PARTITION BY up ORDER BY ratio, k) AS place FROM g{d})",
            f"v{d} AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY up ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, sum(w) OVER (PARTITION BY up ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, CASE WHEN rest > 0 THEN (whole - used) / rest ELSE 0 END AS lvl FROM o{d})",
            f"f{d} AS (SELECT up, arg_min(lvl, place) AS lvl FROM v{d} WHERE cap > lvl * w GROUP BY up)",
            f"t{d} AS (SELECT k AS k{d}, least(cap, coalesce(f{d}.lvl * w, cap)) AS take{d}, CASE WHEN sum(w) OVER (PARTITION BY up) > 0 THEN goal * w / sum(w) OVER (PARTITION BY up) ELSE 0 END AS target{d} FROM v{d} LEFT JOIN f{d} USING (up))",
            f"r{d} AS (SELECT * FROM r{d - 1} JOIN t{d} USING (k{d}))",
        ]
    out += [
        f"cuts AS (SELECT {leaf}, CASE WHEN take{n} >= supply THEN {epochs} ELSE floor(take{n} / tokens)::INT END AS whole, CASE WHEN take{n} >= supply THEN 0 ELSE take{n} - floor(take{n} / tokens) * tokens END AS spare FROM r{n})",
        f"placed AS (SELECT dealt.*, whole, spare, ('0x' || substr(md5(h::VARCHAR || ':' || whole::VARCHAR), 1, 15))::BIGINT AS e FROM dealt JOIN cuts USING ({leaf}) WHERE mix_tokens > 0)",
        f"ordered AS (SELECT *, sum(mix_tokens) OVER (PARTITION BY {leaf} ORDER BY e) AS upto FROM placed)",
        f"mixed AS (SELECT {', '.join(columns)}, {leaf}, mix_tokens, whole + (upto <= spare)::INT AS mix_copies FROM ordered WHERE whole + (upto <= spare)::INT > 0)",
    ]
    return "WITH " + ",\n".join(out)
