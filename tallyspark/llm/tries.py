"""Prefix trie of conversations: one row for each distinct sequence of first turns.

Turns are numbered in a dictionary, so a conversation is a string of ids. Most significant digit first, the
conversations of a bucket (those that share a prefix) are dealt into the buckets of their next turn, by a join and
an aggregation that hold for all buckets at once; each bucket is a node. The root is always dealt out. A bucket with
more than ``LOCAL`` turns left is dealt again, first past the end of the prefix that all its members share. A bucket
with one member is a chain of nodes, which its turns give row by row. All others are finished where they lie, several
in a task, by multikey quicksort: three-way partitions by the turn at one depth, whose middle parts are the nodes.

So the rounds are as many as the levels at which large buckets part, and no task holds more than one bucket of ``LOCAL``
turns beside a batch. Subtree sums go up the dealt levels, last round first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import kept

#: Turns of the largest bucket that one task finishes.
LOCAL = 1 << 14
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest and bytes of each turn, in the order of turn (null first), then role, then the text's digest.

    Null role and text are empty; rows without a conv_id belong to no conversation and are left out; repeated rows
    are turns of their own. Turns are dealt out in ranges of their order, so that one conversation may take
    many tasks; what each task has counted is added up by conversation.
    """
    spark = conversations.sparkSession
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.octet_length(text).cast("long").alias("bytes"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("row")]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            heads = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            at = np.arange(len(conv)) - np.repeat(heads, np.diff(np.append(heads, len(conv))))
            if conv[0] == last:
                at[: heads[1] if len(heads) > 1 else len(conv)] += done
            last, done = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_pydict({"conv_id": conv, "part": np.full(len(conv), part, np.int64), "at": at, "digest": batch.column("digest"), "bytes": batch.column("bytes")})

    found = kept(ranged.select("conv_id", "digest", "bytes").mapInArrow(count, "conv_id long, part long, at long, digest binary, bytes long"))
    # of each conversation that goes on into further tasks, a row for each of these: as many as there are tasks at most
    spans = found.groupBy("conv_id", "part").agg((F.max("at") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = spans.withColumn("before", before).where("before > 0").select("conv_id", "part", "before")
    return found.join(F.broadcast(later), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "bytes")


def coded(turns: DataFrame) -> DataFrame:
    """conv_id, pos, id and bytes: each distinct turn has an id in the dictionary."""
    turns = kept(turns)
    words = kept(turns.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()))
    return turns.join(words, "digest").select("conv_id", "pos", "id", "bytes")


def taken() -> Column:
    """How many turns a rebuilt conversation takes from the first of its five."""
    return (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation c as the first h turns of conversation c - c % 5 and its own turns after its first h (h: ``taken``).

    Gives the turns, and all conversations with their length, which may be 0. c % 5 has the sign of c.
    """
    turns = kept(turns)
    lengths = kept(turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n")))
    of = lengths.select("conv_id", "n", taken().alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    convs = of.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = kept(convs.select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("first"), "n"))
    heads = convs.where("first > 0").select("conv_id", "base", "first").join(turns.where("pos < 8").select(F.col("conv_id").alias("base"), "pos", "id", "bytes"), "base").where("pos < first")
    own = turns.join(convs.select("conv_id", "h", "first"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("first")).alias("pos"), "id", "bytes")
    return heads.select("conv_id", "pos", "id", "bytes").unionByName(own), convs.select("conv_id", (F.col("first") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))


def quicksort(members: list[tuple[int, list[int], list[int]]], top: tuple[int, int, int | None, int]) -> list[list]:
    """The nodes of a bucket, from its members (id, turns left, bytes of these), in the order of their ids.

    top: the bucket's own conv_id, depth, parent_conv_id and bytes of its last turn. Multikey quicksort with a
    stack of its own; a node's row is NODE with ends as a list.
    """
    conv, depth, parent, size = top
    out = [[conv, depth, parent, len(members), 0, 0, (len(members) - 1) * size, []]]
    ups = [-1]
    todo = [(members, 0, 0)]
    while todo:
        rows, at, node = todo.pop()
        if len(rows) == 1:  # a chain
            c, ids, _ = rows[0]
            for d in range(at, len(ids)):
                out[node][4] += 1
                out.append([c, depth + d + 1, out[node][0], 1, 0, 0, 0, []])
                ups.append(node)
                node = len(out) - 1
            out[node][7].append(c)
            continue
        symbol = [ids[at] if at < len(ids) else -1 for _, ids, _ in rows]
        pivot = symbol[len(symbol) // 2]
        less, same, more = [], [], []
        for s, row in zip(symbol, rows, strict=True):
            (same if s == pivot else less if s < pivot else more).append(row)
        for part in (less, more):
            if part:
                todo.append((part, at, node))
        if pivot < 0:
            out[node][7] += [c for c, _, _ in same]
        else:
            out[node][4] += 1
            out.append([same[0][0], depth + at + 1, out[node][0], len(same), 0, 0, (len(same) - 1) * same[0][2][at], []])
            ups.append(node)
            todo.append((same, at + 1, len(out) - 1))
    for i in range(len(out) - 1, -1, -1):  # children stand after their parents
        row = out[i]
        row[5] = row[5] or 1
        if i:
            out[ups[i]][5] += row[5]
            out[ups[i]][6] += row[6]
    return out


def _finish(rows: DataFrame) -> DataFrame:
    """Nodes of all small buckets, and whether a node is its bucket's top. rows: node, depth, parent, size, conv_id, and pos, id, bytes of each turn left (null where none is)."""
    kinds = {"conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "top": pa.bool_()}

    def bucket(rows: list[tuple]) -> list[list]:
        members: list[tuple[int, list[int], list[int]]] = []
        for _, _, _, _, conv, i, n in rows:
            if not members or members[-1][0] != conv:
                members.append((conv, [], []))
            if i is not None:
                members[-1][1].append(i)
                members[-1][2].append(n)
        made = quicksort(members, rows[0][:4])
        for k, row in enumerate(made):
            row[7] = hashlib.sha256(",".join(map(str, sorted(row[7]))).encode()).hexdigest() if row[7] else EMPTY
            row.append(k == 0)
        return made

    def table(made: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in zip(kinds, zip(*made, strict=True), strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            made: list[list] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[0][0] != row[0]:
                    made += bucket(held)
                    held = []
                held.append(row)
            if made:
                yield table(made)
        if held:
            yield table(bucket(held))

    return rows.repartition("node").sortWithinPartitions("node", "conv_id", "pos").select("node", "depth", "parent", "size", "conv_id", "id", "bytes").mapInArrow(run, f"{NODE}, top boolean")


def ends(rows: DataFrame) -> DataFrame:
    """node, depth and ends_sha256 from (node, depth, conv_id): the digest of the ascending ids, joined by commas.

    A list may be as long as the table, and its digest can only be made in order: ids are joined in parts by tasks of a
    range each, and a node's task reads the parts one by one and keeps none.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list]]:
        for batch in batches:
            key = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            at = [i for i in range(len(key)) if not i or key[i] != key[i - 1]] + [len(key)]
            for a, b in zip(at, at[1:], strict=False):
                yield key[a], batch.column(2).slice(a, b - a).to_pylist()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node, depth), ids in runs(batches):
            yield pa.RecordBatch.from_pydict({"node": [node], "depth": [depth], "first": [ids[0]], "text": [",".join(map(str, ids))]})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, hashlib.sha256()
        give = lambda: pa.RecordBatch.from_pydict({"node": [last[0]], "depth": [last[1]], "ends_sha256": [state.hexdigest()]})
        for key, texts in runs(batches):
            if key != last:
                if last:
                    yield give()
                last, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(texts).encode())
        if last:
            yield give()

    order = ["node", "depth", "conv_id"]
    parts = rows.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(join, "node long, depth long, first long, text string")
    return parts.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").select("node", "depth", "text").mapInArrow(digest, "node long, depth long, ends_sha256 string")


def _shared(at: DataFrame, tops: DataFrame, seqs: DataFrame) -> DataFrame:
    """stems: a row for each bucket of ``tops`` and each further node that all its members go through; bottom: the depth of the last of these."""
    alone = tops.where("n_convs = of")  # the bucket above didn't part, so this one may go on together as well
    levels = at.join(alone.select("node", "n_convs"), "node").join(seqs, "conv_id").where("pos >= depth").groupBy("node", "depth", "n_convs", "pos").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    levels = kept(levels.withColumn("parts", (F.col("a") != F.col("b")) | (F.col("n") < F.col("n_convs"))))
    # nobody's turns: the longest member's end
    bottom = levels.groupBy("node").agg(F.coalesce(F.min(F.when(F.col("parts"), F.col("pos"))), F.max("pos") + 1).alias("bottom"))
    chain = levels.join(bottom, "node").where("pos < bottom").select("node", (F.col("pos") + 1).alias("depth"), F.col("node").alias("parent"), "n_convs", F.col("bytes").alias("size"), "bottom")
    return tops.join(bottom, "node", "left").select("node", "depth", "parent", "n_convs", "size", F.coalesce("bottom", "depth").alias("bottom")).unionByName(chain)


def trie(seqs: DataFrame, convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """seqs: conv_id, pos, id, bytes; convs: conv_id, len, also those without turns. One row for each node.

    conv_id: smallest member; depth; parent_conv_id (root: null); n_convs; n_children; n_leaves and saved_tokens of its
    subtree, itself included; ends_sha256 of the members that end here. Equal conversations are members of the same
    nodes; one without turns ends at the root. Without conversations there is no root and no row.
    """
    seqs, convs = kept(seqs), kept(convs)
    whole = convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n")).first()
    number = lambda x: F.lit(x).cast("long")
    none = number(None)
    stems = convs.sparkSession.createDataFrame([(whole.node, 0, None, whole.n, 0, 0)] if whole.n else [], "node long, depth long, parent long, n_convs long, size long, bottom long")
    at = convs.select("conv_id", "len", number(whole.node).alias("node"), number(0).alias("depth"), number(whole.n).alias("n_convs"))
    rounds: list[tuple[DataFrame, DataFrame]] = []
    parts: list[DataFrame] = []
    ended: list[DataFrame] = []
    while True:
        at = kept(at)
        ended.append(at.where("len = depth").select("node", "depth", "conv_id"))
        dealt = kept(seqs.join(at.where("len > depth"), "conv_id").where("pos = depth").select("node", "depth", "n_convs", "conv_id", "len", "id", "bytes"))
        made = dealt.groupBy("node", "depth", "id").agg(F.min("conv_id").alias("child"), F.max("n_convs").alias("of"), F.count("*").alias("n_convs"), F.sum(F.col("len") - F.col("depth")).alias("turns"), F.max("bytes").alias("size"))
        made = kept(made.withColumn("large", (F.col("n_convs") > 1) & (F.col("turns") > local)))
        rounds.append((stems, made))
        below = made.select("node", "depth", "id", "child", F.col("n_convs").alias("k"), "size", "large")
        moved = kept(dealt.drop("n_convs", "bytes").join(below, ["node", "depth", "id"]).select(F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), "size", "conv_id", "len", F.col("k").alias("n_convs"), "large"))
        parts.append(moved.where("NOT large").drop("large"))
        tops = kept(made.where("large").select(F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), "n_convs", "size", "of"))
        if tops.isEmpty():
            break
        stems = kept(_shared(moved.where("large").select("node", "depth", "conv_id"), tops, seqs))
        at = moved.where("large").drop("depth").join(stems.groupBy("node").agg(F.max("bottom").alias("depth")), "node").select("conv_id", "len", "node", "depth", "n_convs")

    members = kept(reduce(DataFrame.unionByName, parts))
    shared = members.where("n_convs > 1")
    idle = shared.where("len = depth").select("node", "depth", "parent", "size", "conv_id", none.alias("pos"), none.alias("id"), none.alias("bytes"))
    turns = kept(members.join(seqs, "conv_id").where("pos >= depth"))
    rest = turns.where("n_convs > 1").select("node", "depth", "parent", "size", "conv_id", "pos", "id", "bytes")
    finished = kept(_finish(rest.unionByName(idle)))
    # a bucket of one member: its own node, and one for each turn left
    lone = members.where("n_convs = 1").select("conv_id", F.col("parent").alias("parent_conv_id"), "depth", "len")
    tail = turns.where("n_convs = 1").select("conv_id", F.col("conv_id").alias("parent_conv_id"), (F.col("pos") + 1).alias("depth"), "len")
    one, nothing = F.lit(1).cast("long"), F.lit(0).cast("long")
    chains = lone.unionByName(tail).select("conv_id", "depth", "parent_conv_id", one.alias("n_convs"), (F.col("depth") < F.col("len")).cast("long").alias("n_children"), one.alias("n_leaves"), nothing.alias("saved_tokens"), F.when(F.col("depth") == F.col("len"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(EMPTY).alias("ends_sha256"))

    tops = finished.where("top").select(F.col("conv_id").alias("child"), F.col("depth").alias("at"), "n_leaves", "saved_tokens")
    out = [finished.drop("top"), chains]
    digests = kept(ends(reduce(DataFrame.unionByName, ended)))
    under = Window.partitionBy("node").orderBy(F.desc("depth"))
    for stems, made in reversed(rounds):
        sums = made.withColumn("at", F.col("depth") + 1).join(tops, ["child", "at"], "left").groupBy("node", "depth").agg(F.count("*").alias("children"), F.sum(F.coalesce("n_leaves", one)).alias("leaves"), F.sum(F.coalesce("saved_tokens", nothing)).alias("saved"))
        nodes = stems.join(sums.withColumnRenamed("depth", "bottom"), ["node", "bottom"], "left").join(digests, ["node", "depth"], "left")
        nodes = nodes.select(
            F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.when(F.col("depth") < F.col("bottom"), one).otherwise(F.coalesce("children", nothing)).alias("n_children"), F.coalesce("leaves", one).alias("n_leaves"),
            (F.coalesce("saved", nothing) + F.sum((F.col("n_convs") - 1) * F.col("size")).over(under)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        )
        nodes = kept(nodes)
        out.append(nodes)
        # what the round above adds up: the dealt buckets by the tops of their stems, beside those finished and those of one member
        heads = nodes.groupBy(F.col("conv_id").alias("child")).agg(F.min("depth").alias("at"), F.max("n_leaves").alias("n_leaves"), F.max("saved_tokens").alias("saved_tokens"))
        tops = finished.where("top").select(F.col("conv_id").alias("child"), F.col("depth").alias("at"), "n_leaves", "saved_tokens").unionByName(heads)
    return reduce(DataFrame.unionByName, out)


def prefix_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are: see ``numbered`` and ``trie``."""
    seqs = kept(coded(numbered(conversations)))
    return trie(seqs, seqs.groupBy("conv_id").agg((F.max("pos") + 1).alias("len")), local)


def rebuilt_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of the rebuilt conversations: see ``rebuilt``."""
    return trie(*rebuilt(coded(numbered(conversations))), local)


def trie_sql() -> str:
    """The trie of the rebuilt conversations in DuckDB: every prefix of every conversation as a list of turns' digests."""
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(c) + 1), lambda i: ascii(c[i])::BIGINT)), lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"
    return f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(id ORDER BY pos) AS ids, list(strlen(text) ORDER BY pos) AS sizes FROM turns GROUP BY conv_id),
h AS (SELECT conv_id, conv_id::VARCHAR AS c, {crc} % 9 AS h FROM own),
seqs AS (SELECT own.conv_id, list_concat(coalesce(b.ids[:h], []), own.ids[h + 1:]) AS ids, list_concat(coalesce(b.sizes[:h], []), own.sizes[h + 1:]) AS sizes FROM own JOIN h USING (conv_id) LEFT JOIN own b ON b.conv_id = own.conv_id - own.conv_id % 5),
paths AS (SELECT conv_id, d AS depth, ids[:d] AS path, ids[:d - 1] AS up, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(ids) AS ends FROM seqs, LATERAL (SELECT unnest(range(0, len(ids) + 1)) AS d)),
nodes AS (SELECT path, any_value(CASE WHEN depth > 0 THEN up END) AS up, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM paths GROUP BY path, depth),
kids AS (SELECT up AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
sums AS (SELECT path[:d] AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM full_nodes, LATERAL (SELECT unnest(range(0, depth + 1)) AS d) GROUP BY 1)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, u.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums USING (path) LEFT JOIN nodes u ON u.path = n.up AND n.depth > 0"""
