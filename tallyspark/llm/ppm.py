"""LM scoring: prediction by partial matching over a trie of byte contexts.

Counts. Every training text is lower-cased, led in by zero bytes and closed by byte 255 (which no
UTF-8 text holds). Blocks of texts send their sorted distinct (ORDER + 1)-byte strings, of all their
texts, with the times that their training texts hold each, cut into parts. A part holds all contexts
with the same last two bytes, so it has every count of its contexts of two bytes and more; what
shorter contexts saw (at most 65,536 pairs of bytes) goes to all parts. Above ``FAN_IN`` blocks, the
lists of as many blocks become one first, level by level, and the answers come back the same way.

Model. A part has all nodes of its contexts, however often seen, so the model grows with the
corpus and is nowhere in one piece. Escapes are by method C (as many as there are different
symbols), and a symbol that a longer context has seen is excluded from the shorter one's counts.

Score. A part answers each block with the log10 probabilities of the strings sent, in their order.
A text's is the sum over its bytes and its end, each from the longest context that the trie has,
with an escape for each order that lacks the byte.

The token baseline needs exact counts of all words, which no broadcast bounds. Blocks send their
sorted distinct word hashes, cut by ranges of the hash, and get back the counts in the same order.
Above ``FAN_IN`` blocks there are as many ranges; the lists of as many blocks become one for each
range, which is cut into as many finer ranges, and so on. So a block sends a bounded number of rows,
and a task has about the words of one block, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat
from .jaccard import planes, unplaned
from .store import kept

ORDER, PARTS = 5, 64
BLOCK_BYTES, FAN_IN = 6 << 20, 256
END = 255
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "kind string, to int, block int, n long, blob binary"


def grams(buf: np.ndarray, off: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The string of order + 1 bytes that ends at each byte and at each text's end, and the text of each."""
    n = len(off) - 1
    size = np.diff(off) + order + 1
    at = np.concatenate([[0], np.cumsum(size)])
    wide = np.zeros(at[-1], np.uint8)
    place = np.ones(at[-1], bool)
    lead = (at[:-1, None] + np.arange(order)).ravel()
    place[lead] = False
    place[at[1:] - 1] = False
    wide[place] = buf
    wide[at[1:] - 1] = END
    key = np.zeros(max(len(wide) - order, 0), np.uint64)
    for j in range(order + 1):
        key = (key << np.uint64(8)) | wide[j : j + len(key)]
    keep = np.ones(len(wide), bool)
    keep[lead] = False
    keep = keep[order:]
    return key[keep], np.repeat(np.arange(n), np.diff(off) + 1)


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often (or with what weight) each occurs."""
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def part_of(keys: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """By the last two bytes of the context."""
    return (flat.mix((keys >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(parts)).astype(np.int64)


def _pack(a: np.ndarray, b: np.ndarray) -> bytes:
    return a.astype("<u8").tobytes() + b.astype("<i8" if b.max(initial=0) >= 1 << 31 else "<i4").tobytes()


def _unpack(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    wide = (len(blob) - 8 * n) // max(n, 1)
    return np.frombuffer(blob, "<u8", n), np.frombuffer(blob, "<i8" if wide == 8 else "<i4", n, 8 * n).astype(np.int64)


def _squeeze(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + pa.compress(b, "zstd", asbytes=True)


def _loose(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def _listed(keys: np.ndarray, times: np.ndarray) -> bytes:
    """As ``_pack``, for sorted strings, which pack well."""
    return _squeeze(planes(keys.astype("<u8")) + planes(times.astype("<i8" if times.max(initial=0) >= 1 << 31 else "<i4")))


def _list(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    blob = _loose(blob)
    return unplaned(blob[: 8 * n], "<u8"), unplaned(blob[8 * n :], "<i8" if len(blob) == 16 * n else "<i4").astype(np.int64)


def _gram_counts(table: pa.Table, order: int, seen: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of a block, sorted, and how often its training texts hold each (not ``seen``: zeros)."""
    every, often, pending = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for piece in flat.pieces(iter(table.to_batches()), "__text"):
        strings, of = grams(flat.LOWER[(held := flat.flat(piece.column("__text")))[0]], held[1], order)
        learn = piece.column("__learn").to_numpy(zero_copy_only=False).astype(bool)[of] if seen else np.zeros(len(of), bool)
        for some, factor in ((strings[learn], 1), (strings[~learn], 0)):
            k, t = _counted(some)
            every.append(k)
            often.append(t * factor)
            pending += len(k)
        if pending > 1_000_000:
            k, t = _counted(np.concatenate(every), np.concatenate(often))
            every, often, pending = [k], [t], 0
    return _counted(np.concatenate(every), np.concatenate(often))


def _word_counts(table: pa.Table, seen: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of a block, sorted, and how often the training texts of the block hold each."""
    keys, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for piece in flat.pieces(iter(table.to_batches()), "__text"):
        buf, off = flat.flat(piece.column("__text"))
        buf = flat.LOWER[buf]
        starts, ends = flat.runs(flat.WORD[buf], off)
        h = flat.Hasher(buf)(starts, ends)
        learn = piece.column("__learn").to_numpy(zero_copy_only=False)[flat.owner(off, starts)].astype(np.int64) if seen else np.ones(len(h), np.int64)
        k, t = _counted(h, learn)
        keys.append(k)
        times.append(t)
    return _counted(np.concatenate(keys), np.concatenate(times))


def _blocks(docs: DataFrame, text: str, learn: Column) -> tuple[DataFrame, int]:
    rows = docs.select("doc_id", F.col(text).alias("__text"), F.coalesce(learn, F.lit(False)).alias("__learn"))
    size = rows.agg(F.sum(F.octet_length("__text") + 16).alias("n")).first().n or 0
    n = max(1, -(-int(size) // BLOCK_BYTES))
    # null ids have no hash of their own: the text deals them out
    return rows.withColumn("__block", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("__text"))), F.lit(n)).cast("int")), n


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of the hash begins in sorted keys, and the end; ranges of a multiple of ``n`` lie within them."""
    of = (keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    return np.searchsorted(of, np.arange(n + 1, dtype=np.uint64))


def counts(blocked: DataFrame, n_blocks: int, order: int = ORDER) -> DataFrame:
    """kind ("word", "gram", "pair" or "texts"), to (range of word hashes, or part of the trie), block, n and blob: keys and counts."""
    n_ranges = min(n_blocks, FAN_IN)

    def count(table: pa.Table) -> pa.Table:
        block = table.column("__block")[0].as_py()
        keys, times = _word_counts(table, True)
        bounds = _ranges(keys, n_ranges)
        rows = [("word", r, block, int(b - a), _pack(keys[a:b], times[a:b])) for r, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
        texts = int(np.count_nonzero(table.column("__learn").to_numpy(zero_copy_only=False)))
        k, t = _gram_counts(table, order, True)
        part = part_of(k)
        rows += [("gram", p, block, int((part == p).sum()), _listed(k[part == p], t[part == p])) for p in np.unique(part).tolist()]
        k, t = _counted(k[t > 0] & np.uint64(0xFFFF), t[t > 0])
        rows += [("pair", 0, block, len(k), _listed(k, t))] if len(k) else []
        rows.append(("texts", 0, block, texts, b""))
        return _rows(rows)

    return blocked.groupBy("__block").applyInArrow(count, _SCHEMA)


def _rows(rows: list[tuple]) -> pa.Table:
    names = (("kind", pa.string()), ("to", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("blob", pa.binary()))
    return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(names)})


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct strings of all lists, their counts, and the strings of each list."""
    pairs = [_list(b, n) for b, n in zip(table.column("blob").to_pylist(), table.column("n").to_pylist(), strict=True)]
    return *_counted(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])), [p[0] for p in pairs]


def answers(words: DataFrame, n_blocks: int, n_ranges: int | None = None) -> DataFrame:
    """For each range and block, the corpus counts of the block's words in the order sent; and "total" rows that share out the training words: n distinct ones, blob the sum of their counts."""
    n_ranges = n_ranges or min(n_blocks, FAN_IN)
    n_groups = -(-n_blocks // FAN_IN)
    finer = min(n_groups, FAN_IN)

    def lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        pairs = [_unpack(b, n) for b, n in zip(table.column("blob").to_pylist(), table.column("n").to_pylist(), strict=True)]
        return *_counted(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])), [p[0] for p in pairs]

    def reply(table: pa.Table, keys: np.ndarray, times: np.ndarray, sent: list[np.ndarray]) -> list[tuple]:
        to = table.column("to")[0].as_py()
        wide = "<i8" if times.max(initial=0) >= 1 << 31 else "<i4"
        return [("answer", to, b, len(k), times[np.searchsorted(keys, k)].astype(wide).tobytes()) for b, k in zip(table.column("block").to_pylist(), sent, strict=True)]

    def answer(table: pa.Table) -> pa.Table:
        keys, times, sent = lists(table)
        return _rows([*reply(table, keys, times, sent), ("total", table.column("to")[0].as_py(), -1, int((times > 0).sum()), int(times.sum()).to_bytes(8, "little"))])

    def merge(table: pa.Table) -> pa.Table:
        keys, times, _ = lists(table)
        to, group = table.column("to")[0].as_py(), table.column("__group")[0].as_py()
        bounds = _ranges(keys, n_ranges * finer)[to * finer : (to + 1) * finer + 1]
        return _rows([("word", to * finer + r, group, int(b - a), _pack(keys[a:b], times[a:b])) for r, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a])

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, _, sent = lists(left)
        right = right.sort_by("__finer")
        times = np.concatenate([np.frombuffer(b, "<i8" if len(b) == 8 * n else "<i4").astype(np.int64) for b, n in zip(right.column("blob").to_pylist(), right.column("n").to_pylist(), strict=True)])
        return _rows(reply(left, keys, times, sent))

    if n_groups == 1:
        return words.groupBy("to").applyInArrow(answer, _SCHEMA)
    grouped = words.withColumn("__group", F.pmod("block", F.lit(n_groups)).cast("int"))
    above = kept(answers(kept(grouped.groupBy("to", "__group").applyInArrow(merge, _SCHEMA)), n_groups, n_ranges * finer))
    there = above.where("kind = 'answer'").select("n", "blob", F.col("block").alias("__group"), F.col("to").alias("__finer"), F.expr(f"to div {finer}").cast("int").alias("to"))
    return grouped.groupBy("to", "__group").cogroup(there.groupBy("to", "__group")).applyInArrow(back, _SCHEMA).union(above.where("kind = 'total'"))


def levels(keys: np.ndarray, times: np.ndarray, order: int, least: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By context length, from ``least``: the strings, their counts and their contexts' counts."""
    out = {}
    for j in range(order, least - 1, -1):
        k, t = _counted(keys & np.uint64((1 << 8 * (j + 1)) - 1), times)
        _, first, inverse = np.unique(k >> np.uint64(8), return_index=True, return_inverse=True)
        out[j] = (k, t, (np.add.reduceat(t, first) if len(k) else t)[inverse])
    return out


def pairs_of(sent: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of bytes of the training texts and their counts, on the driver: 65,536 at most, whatever the input."""

    def merge(table: pa.Table) -> pa.Table:
        k, t, _ = _merge(table)
        return _rows([("pair", 0, 0, len(k), _listed(k, t))])

    rows = sent.where("kind = 'pair'").groupBy(F.pmod("block", F.lit(64))).applyInArrow(merge, _SCHEMA).collect()
    lists = [_list(bytes(r.blob), r.n) for r in rows]
    return _counted(np.concatenate([np.zeros(0, np.uint64), *[x[0] for x in lists]]), np.concatenate([np.zeros(0, np.int64), *[x[1] for x in lists]]))


def odds(lists: DataFrame, n_blocks: int, pairs: tuple[np.ndarray, np.ndarray], order: int = ORDER) -> DataFrame:
    """For each part and block, the log10 probabilities of the strings sent in their order ("odds" rows)."""
    shared = lists.sparkSession.sparkContext.broadcast(pairs)

    def reply(table: pa.Table, keys: np.ndarray, value: np.ndarray, lists: list[np.ndarray]) -> pa.Table:
        to = table.column("to")[0].as_py()
        return _rows([("odds", to, b, len(k), _squeeze(planes(value[np.searchsorted(keys, k)]))) for b, k in zip(table.column("block").to_pylist(), lists, strict=True)])

    def last(table: pa.Table) -> pa.Table:
        keys, times, lists = _merge(table)
        nodes = levels(keys[times > 0], times[times > 0], order, 2) | levels(*shared.value, min(order, 1), 0)
        return reply(table, keys, Model(nodes).score(keys).astype("<f4"), lists)

    def merge(table: pa.Table) -> pa.Table:
        k, t, _ = _merge(table)
        return _rows([("gram", table.column("to")[0].as_py(), table.column("__group")[0].as_py(), len(k), _listed(k, t))])

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, _, lists = _merge(left)
        return reply(left, keys, unplaned(_loose(right.column("blob")[0].as_py()), "<f4"), lists)

    if n_blocks <= FAN_IN:
        return lists.groupBy("to").applyInArrow(last, _SCHEMA)
    n_groups = -(-n_blocks // FAN_IN)
    grouped = lists.withColumn("__group", F.pmod("block", F.lit(n_groups)).cast("int"))
    above = odds(kept(grouped.groupBy("to", "__group").applyInArrow(merge, _SCHEMA)), n_groups, pairs, order)
    return grouped.groupBy("to", "__group").cogroup(above.withColumnRenamed("block", "__group").groupBy("to", "__group")).applyInArrow(back, _SCHEMA)


class Lookup:
    """From 64-bit keys to their places: keys in order of a bijective hash, and where each value of its top bits begins."""

    def __init__(self, keys: np.ndarray):
        h = keys * _ODD
        self.order = np.argsort(h, kind="stable")
        self.h = h[self.order]
        self.bits = max(1, int(len(keys)).bit_length())
        self.begin = np.searchsorted(self.h >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.diff(self.begin).max(initial=0))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Places in the order of ``self.h``, -1 where there is none."""
        h = keys * _ODD
        out = np.full(len(keys), -1, np.int64)
        if not len(self.h):
            return out
        at = self.begin[h >> np.uint64(64 - self.bits)].astype(np.int64)
        same = self.h[np.minimum(at, len(self.h) - 1)] == h
        out[same] = at[same]
        todo = np.flatnonzero(~same)
        for step in range(1, self.deepest):
            place = at[todo] + step
            todo, place = todo[place < len(self.h)], place[place < len(self.h)]
            there = self.h[place]
            hit = there == h[todo]
            out[todo[hit]] = place[hit]
            more = there < h[todo]
            todo = todo[more]
            if not len(todo):
                break
        return out


class Model:
    """Log10 probabilities of the strings of each order, and of what their contexts leave to shorter ones."""

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.order = max(levels)
        self.strings, self.contexts, self.seen, self.count, self.escape, self.norm, self.below = {}, {}, {}, {}, {}, {}, {}
        ordered = {j: tuple(x[np.argsort(levels[j][0], kind="stable")] for x in levels[j]) for j in levels}
        for j, (k, t, n) in ordered.items():
            context, first, inverse = np.unique(k >> np.uint64(8), return_index=True, return_inverse=True)
            kinds = np.diff(np.append(first, len(k)))
            kept = np.add.reduceat(t, first) if len(k) else t
            full = n[first]
            outside = kinds + full - kept
            strings, contexts = Lookup(k), Lookup(context)
            self.strings[j], self.contexts[j] = strings, contexts
            self.seen[j] = (np.log10(t) - np.log10((full + kinds)[inverse])).astype(np.float32)[strings.order]
            self.count[j] = np.log10(t).astype(np.float32)[strings.order]
            self.escape[j] = (np.log10(np.maximum(outside, 1e-300)) - np.log10(full + kinds)).astype(np.float32)[contexts.order] if len(k) else np.zeros(0, np.float32)
            if j:
                shorter, often, total = ordered[j - 1]
                mask = np.uint64((1 << 8 * j) - 1)
                taken = np.add.reduceat(often[np.searchsorted(shorter, k & mask)], first) if len(k) else t
                parents, head = np.unique(shorter >> np.uint64(8), return_index=True)
                p = np.searchsorted(parents, context & (mask >> np.uint64(8)))
                sizes = np.diff(np.append(head, len(shorter)))
                sums = np.add.reduceat(often, head) if len(shorter) else often
                rest, out = sums[p] - taken, sizes[p] - kinds + total[head][p] - sums[p]
                self.norm[j] = np.log10(np.maximum(rest + out, 1)).astype(np.float32)[contexts.order]
                self.below[j] = np.where(out > 0, np.log10(np.maximum(out, 1)) - np.log10(np.maximum(rest + out, 1)), 0.0).astype(np.float32)[contexts.order]
        for x in (*self.strings.values(), *self.contexts.values()):
            x.order = None  # only needed to bring values into place
        self.least = -float(np.log10(max(1, 256 - len(ordered[0][0]))))

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 of each string's last byte after those before it."""
        out = np.zeros(len(keys))
        todo, inside = np.arange(len(keys)), np.full(len(keys), -1, np.int64)
        for j in range(self.order, -1, -1):
            k = keys[todo] & np.uint64((1 << 8 * (j + 1)) - 1)
            at = self.strings[j](k)
            hit = at >= 0
            entered = inside >= 0
            gain = np.where(entered, self.count[j][at] - (self.norm[j + 1][inside] if j < self.order and len(self.norm[j + 1]) else 0), self.seen[j][at]) if len(self.seen[j]) else np.zeros(len(k))
            out[todo[hit]] += gain[hit]
            todo, inside, k, entered = todo[~hit], inside[~hit], k[~hit], entered[~hit]
            if not len(todo):
                break
            context = self.contexts[j](k >> np.uint64(8))
            fresh = ~entered & (context >= 0)
            if fresh.any():
                out[todo[fresh]] += self.escape[j][context[fresh]]
            if j < self.order and entered.any():
                out[todo[entered]] += self.below[j + 1][inside[entered]]
            inside = context
        out[todo] += self.least
        return out


def score(docs: DataFrame, learn: Column, text: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and n_bytes, a row for each row of ``docs``.

    ``learn`` says which rows train (null: no). A null or empty text is the end alone: one token.
    Repeated rows count each, and each gets a row; null ids are kept. Without any training row the
    trie is empty and every symbol has the odds of 1 in 256. Columns besides doc_id, the text and
    those that ``learn`` reads aren't looked at.
    """
    ident = docs.schema["doc_id"].dataType.simpleString()
    blocked, n_blocks = _blocks(docs, text, learn)
    sent = kept(counts(blocked, n_blocks, order))
    replies = kept(answers(sent.where("kind = 'word'"), n_blocks))
    texts = int(sent.where("kind = 'texts'").agg(F.sum("n")).first()[0] or 0)
    per = replies.where("kind = 'total'").select("n", "blob").mapInArrow(_totals, "v long, s long").agg(F.sum("v").alias("v"), F.sum("s").alias("s")).first()
    n_train, n_kinds = int(per.s or 0) + texts, int(per.v or 0) + (texts > 0)
    priced = odds(sent.where("kind = 'gram'"), n_blocks, pairs_of(sent), order)
    space = n_train + 0.1 * (n_kinds + 1)

    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": left.column("doc_id").combine_chunks()[:0], **{k: pa.array([], t) for k, t in _OUT}})
        right = right.sort_by("to")
        strings, _ = _gram_counts(left, order, False)
        found = Lookup(strings)
        chance = np.zeros(len(strings))
        chance[np.argsort(part_of(strings), kind="stable")] = np.concatenate([np.zeros(0, "<f4"), *[unplaned(_loose(b), "<f4") for b in right.filter(pc.equal(right.column("kind"), "odds")).column("blob").to_pylist()]])
        chance = chance[found.order]
        right = right.filter(pc.equal(right.column("kind"), "answer"))
        keys, _ = _word_counts(left, False)
        known = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(b, "<i8" if len(b) == 8 * n else "<i4").astype(np.int64) for b, n in zip(right.column("blob").to_pylist(), right.column("n").to_pylist(), strict=True)]])
        parts = []
        for piece in flat.pieces(iter(left.to_batches()), "__text"):
            buf, off = flat.flat(piece.column("__text"))
            buf = flat.LOWER[buf]
            n = piece.num_rows
            starts, ends = flat.runs(flat.WORD[buf], off)
            doc = flat.owner(off, starts)
            c = known[np.searchsorted(keys, flat.Hasher(buf)(starts, ends))]
            base = np.bincount(doc, np.log10((c + 0.1) / space), n) + np.log10((texts + 0.1) / space)
            strings, of = grams(buf, off, order)
            total = np.bincount(of, chance[found(strings)], n)
            words = np.bincount(doc, minlength=n)
            parts.append(pa.table({"doc_id": piece.column("doc_id"), "n_tokens": (words + 1).astype(np.int64), "n_known": np.bincount(doc[c > 0], minlength=n).astype(np.int64) + int(texts > 0), "train_tokens": np.full(n, n_train, np.int64), "base_score": base, "score": total, "n_bytes": np.diff(off)}))
        return pa.concat_tables(parts)

    answered = replies.where("kind = 'answer'").select("kind", F.col("block").alias("__block"), "to", "n", "blob").union(priced.select("kind", F.col("block").alias("__block"), "to", "n", "blob"))
    return blocked.groupBy("__block").cogroup(answered.groupBy("__block")).applyInArrow(of_block, f"doc_id {ident}, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")


_OUT = (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield flat.table({"v": batch.column("n"), "s": pa.array([int.from_bytes(b, "little") for b in batch.column("blob").to_pylist()], pa.int64())})

