"""N-gram Jaccard join: all pairs of texts whose word-shingle sets overlap enough, and their components.

Token-combination prefixes. Shingles are put into classes by the number of texts that hold them:
rare ones first, then frequent ones by rising powers of two. Each text sorts its set by class and
hash and takes a prefix one longer than the overlap asks for, so that two linked texts share two
shingles of their prefixes at least: either a rare one, or two frequent ones. So rare shingles are
indexed one by one, and frequent ones by pairs. Texts with more than ``DENSE`` frequent shingles in
the prefix (members of large groups of near copies, mostly) index them one by one in a space of
their own, in which the other texts that have two or more show up as well, so that no link is lost.

Candidates. Texts that share an index key form a group. First each text is checked against the
member of its groups that most of them name as their first; a check compares parity bits, as many as the set's size asks
for, then whole sets. Then, in
groups whose members are not yet in one component, all pairs across components are checked, but for
those whose sizes or parity bits show that they can't link. So all pairs of a group are never built
for copies of one another, and every link counts in the end.

Groups of many texts without links come from shingles that many texts share and that the list of
frequent ones had no room for. Above ``DIRECT`` pairs a group isn't joined: its members get an index of their own,
in which shingles are ordered by their exact number among all such members, and which is cut into bands of like set sizes, since sets of
about one size need a larger overlap and so a shorter prefix. What all members of a group share
comes last in that order, so texts meet again only by what is rare among them.

Frequent shingles are broadcast, ``FREQUENT`` at most: the least count that keeps within that bound
decides what is frequent, which changes the work but never the result.

Sets are of 48-bit hashes: two shingles of a text fall together once in 3e14 pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType

from . import flat
from .components import components
from .store import kept

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
FREQUENT, LEAST, DENSE = 1_000_000, 16, 16
ROWS = 2000
#: Ids up to this many are broadcast to pick texts for checks; beyond, they are joined by shuffle.
IDS = 1_000_000
#: Pairs of a group up to which its members are compared as they are.
DIRECT = 1 << 20
#: Pairs of a part that checks them, about, and texts of a block of those that meet.
PAIRS, SIDE = 1000, 500
#: Set sizes of a band are within this factor.
BAND = 1.1
#: 64-bit words of parity bits of a set.
WORDS = 8
_MASK = np.uint64((1 << 48) - 1)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in flat.pieces(batches, "__text"):
        for at in range(0, piece.num_rows, ROWS):
            yield piece.slice(at, ROWS)


def sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sets of a piece of at most ``ROWS`` texts: hashes, sorted within their text; text of each; the n + 1 offsets.

    With fewer than ``size`` words, the whole sequence is one shingle; without words, none.
    """
    buf, off = flat.flat(texts)
    buf = flat.LOWER[buf]
    n = len(off) - 1
    starts, ends = flat.runs(flat.WORD[buf], off)
    doc = flat.owner(off, starts)
    words = flat.Hasher(buf)(starts, ends)
    keys, at = flat.shingles(words, doc, size)
    of = doc[at]
    count = np.bincount(doc, minlength=n)
    if ((count > 0) & (count < size)).any():
        first = np.searchsorted(doc, np.arange(n))
        for m in range(1, size):
            short = np.flatnonzero(count == m)
            h = np.full(len(short), m, np.uint64)
            for j in range(m):
                h = flat.mix(h) + words[first[short] + j]
            keys, of = np.append(keys, flat.mix(h)), np.append(of, short)
    both = np.sort((of.astype(np.uint64) << np.uint64(48)) | (keys >> np.uint64(16)))
    if len(both):
        both = both[np.append(True, both[1:] != both[:-1])]
    of = (both >> np.uint64(48)).astype(np.int64)
    return both & _MASK, of, np.searchsorted(of, np.arange(n + 1))


def fine(keys: np.ndarray, of: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parity bits of each set, two to four for a shingle and 64 at least: a power of two, so that a longer run folds onto a shorter one."""
    bits = np.int64(64) << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / 32))).astype(np.int64)
    off = np.append(0, np.cumsum(bits))
    spot = off[of] + (flat.mix(keys + np.uint64(7)) & (bits[of] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(spot, minlength=off[-1]) & 1).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((off // 8).astype(np.int32)), pa.py_buffer(odd)])


def differing(x: bytes, y: bytes) -> int:
    """How many parity bits of two sets differ: no more than the shingles that one of them has alone."""
    if len(x) < len(y):
        x, y = y, x
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    return int(np.bitwise_count(np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0) ^ b).sum())


def profiles(docs: DataFrame, text: str, size: int) -> DataFrame:
    """doc_id, n, same (a hash of the whole set; 0 for the empty set), the words of its parity bits, and as many such bits as its size asks for (``fine``), for each row.

    Every shingle flips one of ``64 * WORDS`` bits, so two sets differ in as many shingles at least
    as their bits differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in cut(batches):
            keys, of, off = sets(piece.column("__text"), size)
            total = np.concatenate([[np.uint64(0)], np.cumsum(flat.mix(keys + np.uint64(1)), dtype=np.uint64)])
            n = np.diff(off)
            same = flat.mix((total[off[1:]] - total[off[:-1]]) ^ (n.astype(np.uint64) << np.uint64(40)))
            spot = (flat.mix(keys + np.uint64(7)) % np.uint64(64 * WORDS)).astype(np.int64)
            odd = np.bincount(of * 64 * WORDS + spot, minlength=len(n) * 64 * WORDS) & 1
            words = np.packbits(odd.astype(np.uint8)).view("<i8").reshape(len(n), WORDS)
            yield flat.table({"doc_id": piece.column("doc_id"), "n": n.astype(np.int64), "same": np.where(n > 0, same, 0).astype(np.int64)} | {f"w{i}": words[:, i].copy() for i in range(WORDS)} | {"fine": fine(keys, of, n)})

    return docs.select("doc_id", F.col(text).alias("__text")).mapInArrow(run, "doc_id long, n long, same long" + "".join(f", w{i} long" for i in range(WORDS)) + ", fine binary")


def planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes, then all second bytes and so on: what varies little packs well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplaned(blob: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


def _dealt(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """keys, of 32 + bits bits, are sorted: (bucket, from, to) of the top bits."""
    edge = np.searchsorted(keys >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64))
    for b in np.flatnonzero(edge[1:] > edge[:-1]):
        yield int(b), int(edge[b]), int(edge[b + 1])


def _steps(keys: np.ndarray) -> bytes:
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return planes(np.diff(low, prepend=np.uint32(0)))


def _unstepped(blob: bytes) -> np.ndarray:
    return np.cumsum(unplaned(blob, "<u4"), dtype=np.uint64)


def frequent(docs: DataFrame, text: str, size: int, bits: int, room: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts hold, by their top 32 + bits bits (sorted), and their class; copies within a task count once."""
    shift = np.uint64(16 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            held.clear()
            for b, lo, hi in _dealt(keys, bits):
                yield flat.table({"to": pa.array([b], pa.int32()), "blob": pa.array([_steps(keys[lo:hi])], pa.binary())})

        for piece in cut(batches):
            keys, of, off = sets(piece.column("__text"), size)
            total = np.concatenate([[np.uint64(0)], np.cumsum(flat.mix(keys), dtype=np.uint64)])
            whole = (total[off[1:]] - total[off[:-1]]).tolist()
            new = np.array([not (w in seen or seen.add(w)) for w in whole], bool)
            held.append(keys[new[of]] >> shift)
            if sum(map(len, held)) > 2_000_000:
                yield from flush()
        yield from flush()

    def most(table: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([_unstepped(b) for b in table.column("blob").to_pylist()]))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.diff(np.append(first, len(keys)))
        often = n >= LEAST
        top = np.int64(table.column("to")[0].as_py()) << 32
        return pa.table({"key": keys[first][often].astype(np.int64) | top, "n": n[often].astype(np.int64)})

    rows = kept(docs.select(F.col(text).alias("__text")).mapInArrow(count, "to int, blob binary").groupBy("to").applyInArrow(most, "key long, n long"))
    sizes = {r[0]: r[1] for r in rows.groupBy(F.floor(F.log2("n")).alias("c")).agg(F.count("*").alias("k")).collect()}
    least, total = max(sizes, default=0) + 1, 0
    while sizes and least > min(sizes) and total + sizes.get(least - 1, 0) <= room:
        least -= 1
        total += sizes.get(least, 0)
    found = rows.where(F.col("n") >= F.lit(2).cast("double") ** least).toArrow().sort_by("key") if total else None
    if found is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    return found.column("key").to_numpy().astype(np.uint64), np.floor(np.log2(found.column("n").to_numpy())).astype(np.uint8)


def index(docs: DataFrame, text: str, size: int, bits: int, often: tuple[np.ndarray, np.ndarray], numerator: int, denominator: int) -> DataFrame:
    """to (bucket) and blob (keys, ids and dense flags) of all prefixes."""
    shift = np.uint64(16 - bits)
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of, class_of = shared.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys, ids, dense = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(keys, kind="stable")
            keys, ids, dense = keys[order], ids[order], dense[order]
            for b, lo, hi in _dealt(keys, bits):
                yield flat.table({"to": pa.array([b], pa.int32()), "n": pa.array([hi - lo], pa.int64()), "blob": pa.array([_steps(keys[lo:hi]) + planes(ids[lo:hi]) + dense[lo:hi].tobytes()], pa.binary())})

        for piece in cut(batches):
            keys, of, off = sets(piece.column("__text"), size)
            total = np.concatenate([[np.uint64(0)], np.cumsum(flat.mix(keys), dtype=np.uint64)])
            whole = (total[off[1:]] - total[off[:-1]]).tolist()
            ids = piece.column("doc_id")
            usable = np.array([i is not None and not (w in seen or seen.add(w)) for i, w in zip(ids.to_pylist(), whole, strict=True)], bool)
            ids = ids.fill_null(0).to_numpy()
            keep = usable[of]
            keys, of = keys[keep], of[keep]
            if not len(keys):
                continue
            kind = np.zeros(len(keys), np.uint64)
            if len(keys_of):
                at = np.minimum(np.searchsorted(keys_of, keys >> shift), len(keys_of) - 1)
                kind = np.where(keys_of[at] == keys >> shift, class_of[at], 0).astype(np.uint64)
            both = np.sort((of.astype(np.uint64) << np.uint64(53)) | (kind << np.uint64(48)) | keys)
            kind, keys = (both >> np.uint64(48)) & np.uint64(31), both & _MASK
            first = np.searchsorted(of, np.arange(len(off)))
            n = np.diff(first)
            prefix = np.minimum(n, n - -(-numerator * n // denominator) + 2)
            inside = np.arange(len(keys)) - first[of] < prefix[of]
            rare = inside & (kind == 0)
            heavy = np.flatnonzero(inside & (kind > 0))
            f = np.bincount(of[heavy], minlength=len(n))
            heavy = heavy[f[of[heavy]] > 1]
            dense = f > DENSE
            out = [(flat.mix(keys[rare] ^ np.uint64(0x1111 << 48)), ids[of[rare]], np.ones(rare.sum(), np.uint8))]
            if len(heavy):
                out.append((flat.mix(keys[heavy] ^ np.uint64(0x2222 << 48)), ids[of[heavy]], dense[of[heavy]].astype(np.uint8)))
                few = heavy[~dense[of[heavy]]]
                for j in range(1, DENSE):
                    a, b = few[:-j], few[j:]
                    pair = of[a] == of[b]
                    a, b = a[pair], b[pair]
                    if not len(a):
                        break
                    out.append((flat.mix(flat.mix(keys[a]) + keys[b]), ids[of[a]], np.ones(len(a), np.uint8)))
            held += [(k >> np.uint64(32 - bits), i, d) for k, i, d in out]
            if sum(len(x[0]) for x in held) > 1_000_000:
                yield from flush()
        yield from flush()

    return docs.select("doc_id", F.col(text).alias("__text")).mapInArrow(run, "to int, n long, blob binary")


def groups(indexed: DataFrame) -> DataFrame:
    """kind, a, b, n: "pair" rows name the first member a of n groups that b is in; "group" rows have a group's hash as a and a member as b."""

    def meet(table: pa.Table) -> pa.Table:
        parts = []
        for blob, n in zip(table.column("blob").to_pylist(), table.column("n").to_pylist(), strict=True):
            parts.append((_unstepped(blob[: 4 * n]), unplaned(blob[4 * n : 12 * n], "<i8"), np.frombuffer(blob, np.uint8, n, 12 * n)))
        keys, ids, dense = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, keys))
        keys, ids, dense = keys[order], ids[order], dense[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))
        at = np.flatnonzero(new)
        keys, ids, dense = keys[at], ids[at], np.maximum.reduceat(dense, at) if len(at) else dense
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.diff(np.append(first, len(keys)))
        live = (n > 1) & (np.maximum.reduceat(dense, first) > 0)
        # equal groups count once, with the number of keys that have them
        total = np.concatenate([[np.uint64(0)], np.cumsum(flat.mix(ids.astype(np.uint64)), dtype=np.uint64)])
        name = flat.mix((total[first + n] - total[first]) ^ n.astype(np.uint64))[live]
        first, n = first[live], n[live]
        name, one, times = np.unique(name, return_index=True, return_counts=True)
        first, n = first[one], n[one]
        start = np.cumsum(n) - n
        rows = np.repeat(first - start, n) + np.arange(n.sum())
        group, member, hub = np.repeat(name, n), ids[rows], np.repeat(ids[first], n)
        votes = np.repeat(times, n)
        other = member != hub
        pair = np.stack([hub[other], member[other]], 1)
        pair, back = np.unique(pair, axis=0, return_inverse=True) if len(pair) else (pair, np.zeros(0, np.int64))
        said = np.bincount(back.ravel(), votes[other], len(pair)).astype(np.int64)
        return pa.table({"kind": pa.array(["pair"] * len(pair) + ["group"] * len(member), pa.string()), "a": np.concatenate([pair[:, 0], group.astype(np.int64)]), "b": np.concatenate([pair[:, 1], member]), "n": np.concatenate([said, np.repeat(n, n)])})

    return indexed.groupBy("to").applyInArrow(meet, "kind string, a long, b long, n long")


def dealt_out(pairs: DataFrame, parts: int, side: int = SIDE) -> DataFrame:
    """a, b and the part that checks each pair: texts that meet one another go to one part, so that a text is sent once and not once a pair.

    A text's home is the least text that its least partner meets. The texts of a home are cut into blocks of about
    ``side``, and the pairs of two blocks go to one part: k texts that all meet are each sent k / ``side`` times.
    """
    met = pairs.select(F.col("a").alias("v"), F.col("b").alias("o")).union(pairs.select(F.col("b").alias("v"), F.col("a").alias("o")))
    least = kept(met.groupBy("v").agg(F.least("v", F.min("o")).alias("h")))
    home = least.join(least.select(F.col("v").alias("h"), F.col("h").alias("home")), "h").select("v", "home")
    blocks = home.groupBy("home").agg(F.ceil(F.count("*") / side).alias("blocks"))
    at = kept(home.join(blocks, "home").select("v", F.xxhash64("home", F.pmod(F.xxhash64("v"), F.col("blocks"))).alias("block")))
    for x in ("a", "b"):
        pairs = pairs.join(at.select(F.col("v").alias(x), F.col("block").alias(f"{x}_block")), x)
    one, other = F.least("a_block", "b_block"), F.greatest("a_block", "b_block")  # two blocks' pairs in either order are one cell
    return pairs.select("a", "b", F.pmod(F.xxhash64(one, other), F.lit(parts)).cast("int").alias("part"))


def checked(pairs: DataFrame, rows: DataFrame, check: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """The pairs that ``check`` keeps, from the pairs of a part and the ``rows`` (doc_id and more) of their texts."""
    pairs = kept(pairs.select("a", "b").distinct())
    count = pairs.count()
    dealt = kept(dealt_out(pairs, max(1, -(-count // PAIRS))))
    routes = dealt.select(F.explode(F.array("a", "b")).alias("doc_id"), F.col("part").alias("to")).distinct()
    sent = rows.join(F.broadcast(routes) if 2 * count <= IDS else routes, "doc_id")
    return dealt.groupBy("part").cogroup(sent.groupBy("to")).applyInArrow(check, "a long, b long")


def sieved(pairs: DataFrame, profile: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs a < b but for those whose sizes or parity bits show that they don't link, before a text is sent for them."""

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(left.num_rows, bool)
        held: dict[int, set[tuple[int, bytes]]] = {}
        for d, n, bits in zip(*[right.column(c).to_pylist() for c in ("doc_id", "n", "fine")], strict=True):
            held.setdefault(d, set()).add((n, bits))  # an id may have several texts

        def may(n: int, x: bytes, m: int, y: bytes) -> bool:
            return denominator * min(n, m) >= numerator * max(n, m) and differing(x, y) * (numerator + denominator) <= (n + m) * (denominator - numerator)

        for i, (a, b) in enumerate(zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True)):
            found[i] = any(may(n, x, m, y) for n, x in held.get(a, ()) for m, y in held.get(b, ()))
        return left.select(["a", "b"]).filter(pa.array(found))

    return checked(pairs, profile.where("n > 0").select("doc_id", "n", "fine"), check)


def linked(pairs: DataFrame, profile: DataFrame, docs: DataFrame, text: str, size: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs a < b whose sets overlap enough. Whole texts are sent only for pairs that their parity bits leave (``sieved``)."""

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        found_a, found_b = [], []
        if left.num_rows and right.num_rows:
            held: dict[int, list[np.ndarray]] = {}
            for piece in cut(iter(right.to_batches())):
                keys, _, off = sets(piece.column("__text"), size)
                for i, d in enumerate(piece.column("doc_id").to_pylist()):
                    one, have = keys[off[i] : off[i + 1]], held.setdefault(d, [])
                    if not any(np.array_equal(one, x) for x in have):  # an id may have several texts
                        have.append(one)

            def link(x: np.ndarray, y: np.ndarray) -> bool:
                if denominator * min(len(x), len(y)) < numerator * max(len(x), len(y)):
                    return False
                common = int(np.isin(x, y, assume_unique=True).sum())
                return denominator * common >= numerator * (len(x) + len(y) - common)

            for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True):
                if any(link(x, y) for x in held.get(a, ()) for y in held.get(b, ())):
                    found_a.append(a)
                    found_b.append(b)
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("__text"))
    return checked(sieved(pairs, profile, numerator, denominator), texts, check)


def parted(member: DataFrame) -> DataFrame:
    """Of groups whose members (g, v, n, c) aren't in one component c: g, main (the component of most of them) and pairs (how many have a member outside it, at most)."""
    per = member.groupBy("g", "c").agg(F.count("*").alias("k"))
    per = per.groupBy("g").agg(F.max(F.struct("k", "c")).alias("x"), F.count("*").alias("kinds"), F.sum("k").alias("k")).where("kinds > 1")
    return per.select("g", F.col("x.c").alias("main"), ((F.col("k") - F.col("x.k")) * F.col("k")).alias("pairs"))


def regrouped(member: DataFrame, docs: DataFrame, text: str, size: int, numerator: int, denominator: int) -> DataFrame:
    """Groups (g, v, n, c) of the texts v, in which any two of them that link meet, from prefixes in the order of the texts' own shingle counts.

    A shingle that one text alone has is never shuffled back; texts with enough of those for a whole prefix
    meet nobody. Of a set of n shingles and another of m at least, both prefixes of n (m) - need + 1 shingles share one if
    the sets have need in common: prefixes are cut for each band of the partner's size.
    """
    texts = kept(member.select("v", "c").distinct())
    some = F.broadcast(texts.select("v")) if texts.count() <= IDS else texts.select("v")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in cut(batches):
            keys, of, off = sets(piece.column("__text"), size)
            total = np.concatenate([[np.uint64(0)], np.cumsum(flat.mix(keys), dtype=np.uint64)])
            whole, n = (total[off[1:]] - total[off[:-1]]).astype(np.int64), np.diff(off)
            for at in range(0, len(keys), 100_000):
                one = of[at : at + 100_000]
                yield flat.table({"v": piece.column("v").to_numpy()[one], "s": whole[one], "n": n[one].astype(np.int64), "key": keys[at : at + 100_000].astype(np.int64)})

    rows = docs.select(F.col("doc_id").cast("long").alias("v"), F.col(text).alias("__text")).join(some, "v")
    keys = kept(rows.mapInArrow(split, "v long, s long, n long, key long").distinct())
    often = keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    one_set = Window.partitionBy("v", "s", "n")
    ranked = keys.join(often, "key").withColumn("at", F.col("n") - F.count("*").over(one_set) + F.row_number().over(one_set.orderBy("k", "key")))
    band = lambda m: F.floor(F.log(m) / F.log(F.lit(BAND)))
    n = F.col("n")
    least, most = F.greatest(F.ceil(n * numerator / denominator), F.lit(1)), F.floor(n * denominator / numerator)
    met = ranked.where(F.col("at") <= n - least + 1).withColumn("own", band(n)).withColumn("other", F.explode(F.sequence(band(least), band(most))))
    smallest = F.greatest(least, F.floor(F.pow(F.lit(BAND), "other") * (1 - 1e-9)))
    need = F.ceil((n + smallest) * numerator / (numerator + denominator) - 1e-9)
    met = met.where(F.col("at") <= n - need + 1)
    return met.select(F.xxhash64(F.least("own", "other"), F.greatest("own", "other"), "key").alias("g"), "v", "n").distinct().join(texts, "v")


def once(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``docs`` without ids whose sets (members: doc_id, rep) all have another id for their rep: every different set is still there.

    Copies would meet by each shingle of their prefixes. Either the ids that go or those that stay are sent to all tasks, so
    that texts aren't shuffled; if both are too many, ``docs`` as they are, which changes the work and never the result.
    """
    reps = members.select(F.col("rep").alias("doc_id")).distinct()
    copies = kept(members.select("doc_id").distinct().join(reps, "doc_id", "left_anti"))
    if copies.count() <= IDS:
        return docs.join(F.broadcast(copies), "doc_id", "left_anti")
    return docs.join(F.broadcast(reps), "doc_id", "left_semi") if reps.count() <= IDS else docs


def join(docs: DataFrame, text: str = "text", size: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs``.

    Two documents link when denominator * |intersection| >= numerator * |union|; a component's id is
    its smallest doc_id. Null, empty and blank texts have an empty set and link with nothing, not even each other: their
    component is their own id. Rows that share an id are one document, with the links of all its
    texts. A null id has no links and a null component. An empty table gives an empty result. Columns
    besides doc_id and the text aren't read. Ids that are no whole numbers are numbered in their order.
    """
    kind = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", text)
    if not isinstance(kind, IntegralType):
        numbers = kept(docs.select("doc_id").dropna().distinct().orderBy("doc_id").select("doc_id", F.monotonically_increasing_id().alias("__n")))
        by_number = docs.join(numbers, "doc_id", "left").select(F.col("__n").alias("doc_id"), text)
        out = join(by_number, text, size, numerator, denominator)
        name = lambda c: numbers.select(F.col("doc_id").alias(f"__{c}"), F.col("__n").alias(c))
        return out.join(name("doc_id"), "doc_id", "left").join(name("component_id"), "component_id", "left").select(F.col("__doc_id").alias("doc_id"), "n_shingles", F.col("__component_id").alias("component_id"))
    if not isinstance(kind, LongType):
        out = join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), text, size, numerator, denominator)
        return out.select(F.col("doc_id").cast(kind), "n_shingles", F.col("component_id").cast(kind))
    profile = kept(profiles(docs, text, size))
    total = profile.agg(F.sum("n").alias("n")).first().n or 0
    bits = min(16, max(6, int(total // 1_000_000).bit_length()))
    alike = profile.where("doc_id IS NOT NULL AND n > 0")
    first = kept(alike.groupBy("same").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), *[F.min(f"w{i}").alias(f"w{i}") for i in range(WORDS)]))
    # ids that repeat with different texts: all their sets belong to one document
    members = kept(alike.select("doc_id", "same").distinct().join(first.select("same", "rep", "n"), "same").select("doc_id", "rep", "n"))
    single = once(docs, members)
    often = frequent(single, text, size, bits)
    met = kept(groups(index(single, text, size, bits, often, numerator, denominator)))
    # written, so that joins with it on a common member can be split by rows
    of = kept(members.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.min("n").alias("n")))

    def folded(rows: DataFrame, side: str) -> DataFrame:
        return rows.join(of.select(F.col("doc_id").alias(side), F.col("rep").alias(f"{side}_rep"), F.col("n").alias(f"{side}_n")), side)

    near = (F.col("a_n") * denominator >= F.col("b_n") * numerator) & (F.col("b_n") * denominator >= F.col("a_n") * numerator)
    pairs = folded(folded(met.where("kind = 'pair'").select("a", "b", "n"), "a"), "b").where(near & (F.col("a_rep") != F.col("b_rep")))
    pairs = pairs.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))
    best = kept(pairs.groupBy("b").agg(F.max(F.struct("n", F.negative("a").alias("a"))).alias("x")).select(F.negative("x.a").alias("a"), "b"))
    links = kept(linked(best, profile, docs, text, size, numerator, denominator))
    same_id = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    links = links.union(same_id)
    label = components(links)
    member = met.where("kind = 'group'").select(F.col("a").alias("g"), "b").distinct()
    member = folded(member, "b").select("g", F.col("b_rep").alias("v"), F.col("b_n").alias("n")).distinct()
    member = kept(member.join(label.withColumnRenamed("node", "v"), "v", "left").select("g", "v", "n", F.coalesce("component", "v").alias("c")))
    main = kept(parted(member))
    left = member.join(main.where(F.col("pairs") <= DIRECT).select("g", "main"), "g")
    large = main.where(F.col("pairs") > DIRECT).select("g")
    if not large.isEmpty():
        again = kept(regrouped(member.join(large, "g"), docs, text, size, numerator, denominator))
        left = left.unionByName(again.join(parted(again).select("g", "main"), "g").select(*left.columns))
    bits_of = first.groupBy("rep").agg(*[F.min(f"w{i}").alias(f"w{i}") for i in range(WORDS)], F.count("*").alias("k")).select(F.col("rep").alias("v"), "k", *[f"w{i}" for i in range(WORDS)])
    left = kept(left.join(bits_of, "v"))

    def side(x: str) -> DataFrame:
        return left.select("g", *[F.col(c).alias(f"{x}_{c}") for c in left.columns if c != "g"])

    # every pair across components has a member outside the group's largest one; links leave few parity bits apart
    apart = sum((F.bit_count(F.col(f"a_w{i}").bitwiseXOR(F.col(f"b_w{i}"))) for i in range(WORDS)), F.lit(0))
    few = (apart * (numerator + denominator) <= (F.col("a_n") + F.col("b_n")) * (denominator - numerator)) | (F.col("a_k") > 1) | (F.col("b_k") > 1)
    cross = (F.col("a_c") != F.col("b_c")) & ((F.col("b_c") == F.col("b_main")) | (F.col("a_v") < F.col("b_v")))
    met_again = side("a").where("a_c <> a_main").join(side("b"), "g").where(cross & near & few)
    across = met_again.select(F.least("a_v", "b_v").alias("a"), F.greatest("a_v", "b_v").alias("b")).distinct().join(best, ["a", "b"], "left_anti")
    more = kept(linked(across, profile, docs, text, size, numerator, denominator))
    label = components(links.union(more).union(label.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a < b")))
    final = of.join(label, of["rep"] == label["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("c"))
    return profile.join(final, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
