"""Suffix-array dedup: every byte that a 200-byte string covers which also starts elsewhere.

Where strings can meet. The smallest 48-byte hash in a 200-byte window (its anchor) depends on the
window alone, so equal windows have equal anchors. A run of windows with one anchor is a segment.
A bit table of bounded size, filled over all segments, says which anchors occur twice; only those
segments are sent on, dealt out by anchor, a text that repeats as a whole only once. A full table
lets more segments through and never fewer, so results don't depend on its size.

What repeats. A bucket's segments, equal ones once and with their number, are cut by the tasks they
come from into shards of bounded size. Text is read as strings of 8-byte symbols, one for each of 8
offsets. Each shard has its suffixes ordered on its own (prefix doubling), which gives its
Burrows-Wheeler transform: the symbol before each suffix, and the row of the suffix that this symbol
begins. From here on only transforms are read. Their merge is refined as an interleave: at first all
rows are one block, shard after shard. A pass takes each row to the row of its symbol's suffix, whose
key is that symbol and the block it came from. As shards are ordered, their rows come out as runs of
rising keys, and a merge of the runs is the interleave to one symbol more; where the key changes a
block begins, and the number of the pass is the length of the prefix that it has in common with the
block before. After 25 passes the blocks of more than one row are the repeated intervals of 200
bytes. A row alone in its block can't be repeated and goes. The suffixes of all shards are never
sorted together. Symbols are 32-bit codes; a 64-bit hash of the window confirms each interval.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .jaccard import planes, unplaned
from .store import kept

LENGTH, ANCHOR, SYMBOL = 200, 16, 8
#: Bytes of text whose windows are hashed at a time: what a step makes of them stays in a core's cache.
PIECE = 1 << 17
#: Bits of the anchor table: at most 2 to this power.
MOST_BITS = 30
#: Windows merged at a time, and about how many suffixes a shard has.
BATCH, SHARD = 200_000, 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, h.dtype)
    x = np.full(-(-len(h) // width) * width, np.iinfo(h.dtype).max, h.dtype)
    x[: len(h)] = h
    x = x.reshape(-1, width)
    before, after = np.minimum.accumulate(x, 1).ravel(), np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchor_size(length: int) -> int:
    """Bytes of an anchor: a quarter of a window, as longer ones occur again by chance less often, and shorter ones leave longer segments."""
    return max(ANCHOR, length // 4 // SYMBOL * SYMBOL)


def segments(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, by_place: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, text, first window start and number of windows of each segment: neighbouring windows with one smallest hash.

    ``by_place``: also cut where the leftmost place of that hash changes, so that a hash which
    comes again within a segment counts twice.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none.astype(np.uint64), none, none, none
    size = anchor_size(length)
    hashed = flat.Hasher(buf)
    grams = flat.mix((hashed.sums[size:] - hashed.sums[:-size]) * hashed.down[: len(buf) - size + 1])
    least = _minima((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), length - size + 1)
    # where the place of the smallest hash changes, a text begins or its last whole window has begun
    short = np.maximum(off[1:] - length + 1, off[:-1])
    cuts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, off[:-1], short])
    first = np.unique(cuts[cuts < len(least)])
    n = np.diff(first, append=len(least))
    text = np.searchsorted(off, first, "right") - 1
    whole = off[text + 1] - first >= length
    first, n, text = first[whole], n[whole], text[whole]
    anchor = grams[(least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    if not by_place and len(first):
        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
        anchor, text, first, n = anchor[new], text[new], first[new], np.add.reduceat(n, new)
    return anchor, text, first, n


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, __text (never null) and __key, a hash of the whole text."""
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return rows.withColumn("__key", F.xxhash64("__text", F.octet_length("__text")))


def repeated_anchors(texts: DataFrame, bits: int, length: int) -> np.ndarray:
    """The bit table: 1 where two segments of different places fall. Texts equal to one that the task has seen don't count."""
    cells = min(bits - 3, 8)  # buckets, as a power of two

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            spots = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
            held.clear()
            edge = np.searchsorted(spots, np.arange((1 << cells) + 1, dtype=np.uint64) << np.uint64(bits - cells))
            for b in np.flatnonzero(edge[1:] > edge[:-1]):
                yield flat.table({"to": pa.array([b], pa.int32()), "blob": pa.array([planes(np.diff(spots[edge[b] : edge[b + 1]], prepend=np.uint32(b << bits - cells)))], pa.binary())})

        for piece in flat.pieces(batches, "__text", PIECE):
            piece = piece.filter(_unseen(piece, seen))
            anchors, *_ = segments(*flat.flat(piece.column("__text")), length, by_place=True)
            held.append((flat.mix(anchors) >> np.uint64(64 - bits)).astype(np.uint32))
            if sum(map(len, held)) > 1_000_000:
                yield from flush()
        yield from flush()

    def twice(table: pa.Table) -> pa.Table:
        b = table.column("to")[0].as_py()
        spots = np.sort(np.concatenate([np.cumsum(unplaned(x, "<u4"), dtype=np.uint64) for x in table.column("blob").to_pylist()]))
        bit = np.zeros(1 << bits - cells, np.uint8)
        bit[spots[1:][spots[1:] == spots[:-1]]] = 1
        return pa.table({"to": pa.array([b], pa.int32()), "blob": pa.array([np.packbits(bit).tobytes()], pa.binary())})

    out = np.zeros(1 << bits - 3, np.uint8)
    size = len(out) >> cells
    for r in texts.select("__text", "__key").mapInArrow(run, "to int, blob binary").groupBy("to").applyInArrow(twice, "to int, blob binary").toLocalIterator():
        out[r.to * size : (r.to + 1) * size] = np.frombuffer(bytes(r.blob), np.uint8)
    return out


def _unseen(piece: pa.RecordBatch, seen: set[int]) -> pa.Array:
    return pa.array([not (k in seen or seen.add(k)) for k in piece.column("__key").to_pylist()], pa.bool_())


def sent(texts: DataFrame, table: np.ndarray, bits: int, buckets: int, length: int) -> DataFrame:
    """to (bucket of the anchor) and blob: a shard of segments, with n segments in it."""
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit, seen = shared.value, set()
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            anchors, keys, at, n = (np.concatenate([h[i] for h in held]) for i in range(4))
            data = np.concatenate([h[4] for h in held])
            held.clear()
            ends = np.cumsum(n + length - 1)
            order = np.argsort(anchors, kind="stable")
            to = (flat.mix(anchors[order] + np.uint64(5)) % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(to):
                rows = order[to == b]
                size = (n + length - 1)[rows]
                stop = np.cumsum(size)
                body = data[np.repeat(ends[rows] - stop, size) + np.arange(stop[-1])]
                yield flat.table({"to": pa.array([b], pa.int32()), "n": pa.array([len(rows)], pa.int64()), "blob": pa.array([planes(anchors[rows]) + planes(keys[rows]) + planes(at[rows].astype(np.int64)) + planes(n[rows].astype(np.int64)) + body.tobytes()], pa.binary())})

        for piece in flat.pieces(batches, "__text", PIECE):
            piece = piece.filter(_unseen(piece, seen))
            buf, off = flat.flat(piece.column("__text"))
            anchors, text, first, n = segments(buf, off, length)
            spot = flat.mix(anchors) >> np.uint64(64 - bits)
            hit = (bit[(spot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (spot & np.uint64(7)).astype(np.uint8)) & 1) > 0
            anchors, text, first, n = anchors[hit], text[hit], first[hit], n[hit]
            if not len(n):
                continue
            size = n + length - 1
            stop = np.cumsum(size)
            held.append((anchors, piece.column("__key").to_numpy()[text], first - off[text], n, buf[np.repeat(first - stop + size, size) + np.arange(stop[-1])]))
            if sum(len(h[4]) for h in held) > 10_000_000:
                yield from flush()
        yield from flush()

    return texts.select("__text", "__key").mapInArrow(run, "to int, n long, blob binary")


def codes(data: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The symbol that begins at each place, as 32 bits; 0 where fewer than 8 bytes are left (``room``)."""
    wide = np.zeros(len(data) + SYMBOL, np.uint8)
    wide[: len(data)] = data
    out = np.maximum((np.ndarray((len(data),), "<u8", wide, 0, (1,)) * _ODD) >> np.uint64(32), np.uint64(1)).astype(np.uint32)
    out[room < SYMBOL] = 0
    return out


def _edges(keys: np.ndarray) -> np.ndarray:
    edge = np.ones(len(keys) + 1, bool)
    edge[1:-1] = keys[1:] != keys[:-1]
    return edge


def suffix_order(code: np.ndarray, room: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A shard's suffixes in order of their first ``length`` bytes at least, by prefix doubling; an end comes before any symbol."""
    n = len(code)
    after = np.zeros(n, np.uint32)
    after[: max(n - SYMBOL, 0)] = code[SYMBOL:]
    after[room < SYMBOL] = 0
    key = code.astype(np.uint64) << np.uint64(32) | after
    order = np.argsort(key)
    rank, slots, rows, key, depth = np.zeros(n, np.uint32), np.arange(n), order, key[order], 2 * SYMBOL
    while True:
        edge = _edges(key)
        rank[rows] = slots[np.maximum.accumulate(np.where(edge[:-1], np.arange(len(rows)), 0))] + 1
        tied = ~(edge[1:] & edge[:-1])
        slots, rows = slots[tied], rows[tied]
        if depth >= length or not len(rows):
            return order
        then = np.where(room[rows] >= depth, rank[np.minimum(rows + depth, n - 1)], 0)
        key = rank[rows].astype(np.uint64) << np.uint64(32) | then.astype(np.uint64)
        by = np.argsort(key)
        rows, key = rows[by], key[by]
        order[slots] = rows
        depth *= 2


def transforms(code: np.ndarray, room: np.ndarray, cuts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the shards between ``cuts``, one after another: each row's suffix, the symbol before it, and the row of the suffix that begins with that symbol."""
    suffix = np.concatenate([a + suffix_order(code[a:b], room[a:b], length) for a, b in zip(cuts, cuts[1:], strict=False)])
    row = np.empty(len(suffix), np.int64)
    row[suffix] = np.arange(len(suffix))
    before = np.maximum(suffix - SYMBOL, 0)
    return suffix, code[before], row[before]


def merge(symbol: np.ndarray, to: np.ndarray, rows: np.ndarray, many: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The rows that the interleave of all shards, refined to ``length`` bytes, leaves in a repeated interval, and the number of each one's interval, in order.

    ``rows``: those that have ``length`` bytes before them in their text. ``many``: rows that stand for several suffixes.
    """
    key, here = np.empty(len(to), np.uint64), np.zeros(len(to), bool)
    block = np.zeros(len(rows), np.uint64)
    for _ in range(length // SYMBOL):
        if not len(rows):
            break
        ahead = to[rows]
        key[ahead] = symbol[rows].astype(np.uint64) << np.uint64(32) | block
        here[ahead] = True
        rows = np.flatnonzero(here)
        here[rows] = False
        keys = key[rows]
        order = np.argsort(keys, kind="stable")
        edge = _edges(keys[order])
        block = np.empty(len(rows), np.uint64)
        block[order] = np.cumsum(edge[:-1])
        shared = np.empty(len(rows), bool)
        shared[order] = ~(edge[1:] & edge[:-1])
        shared |= many[rows]
        rows, block = rows[shared], block[shared]
    return rows, block


def repeated(data: np.ndarray, sizes: np.ndarray, times: np.ndarray, length: int = LENGTH, shard: int = SHARD) -> np.ndarray:
    """Places in ``data`` (segments of these ``sizes``, each there ``times`` times) at which a string begins that is there twice."""
    # a place of its own for each segment's end
    wide = sizes + 1
    stop = np.cumsum(wide)
    n = int(stop[-1])
    place = np.arange(n) - np.repeat(stop - wide, wide)
    room = np.repeat(sizes, wide) - place
    own = np.repeat(np.arange(len(sizes)), wide)
    code = codes(data[np.minimum(np.arange(n) - own, len(data) - 1)], room)
    ends = stop[np.append(stop[1:] // shard != stop[:-1] // shard, True)]
    suffix, symbol, to = transforms(code, room, np.append(0, ends), length)
    found, block = merge(symbol, to, np.flatnonzero(place[suffix] >= length), (times > 1)[own[suffix]], length)
    found = suffix[found]
    lone = times[own[found]] == 1
    found = found - own[found]
    name = flat.Hasher(data)(found, found + length)
    order = np.lexsort((name, block))
    name, block = name[order], block[order]
    same = (block[1:] == block[:-1]) & (name[1:] == name[:-1])
    return np.sort(found[order[np.append(False, same) | np.append(same, False) | ~lone[order]]]) if len(found) else found


def covered(rows: DataFrame, length: int) -> DataFrame:
    """key, a, b: bytes [a, b) of the text with that key are covered."""

    def run(table: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for blob, n in zip(table.column("blob").to_pylist(), table.column("n").to_pylist(), strict=True):
            anchors, keys, at, count = (unplaned(blob[8 * n * i : 8 * n * (i + 1)], t) for i, t in enumerate(("<u8", "<i8", "<i8", "<i8")))
            for p, x in zip(parts, (anchors, keys, at, count, np.frombuffer(blob, np.uint8, -1, 32 * n)), strict=True):
                p.append(x)
        anchors, keys, at, n, data = (np.concatenate(p) for p in parts)
        size = n + length - 1
        begin = np.cumsum(size) - size
        # copies of one text bring the same segments
        order = np.lexsort((at, keys, anchors))
        new = np.append(True, (anchors[order][1:] != anchors[order][:-1]) | (keys[order][1:] != keys[order][:-1]) | (at[order][1:] != at[order][:-1]))
        rows = np.sort(order[new])
        order = rows[np.argsort(anchors[rows], kind="stable")]
        out_key, out_a, out_b = [], [], []
        cuts = np.concatenate([[0], np.flatnonzero(anchors[order][1:] != anchors[order][:-1]) + 1, [len(order)]])
        load = np.concatenate([[0], np.cumsum(n[order])])[cuts]
        i = 0
        while i < len(cuts) - 1:
            j = max(i + 1, int(np.searchsorted(load, load[i] + BATCH, "right")) - 1)
            mine = np.sort(order[cuts[i] : cuts[j]])
            i = j
            count = size[mine]
            stop = np.cumsum(count)
            local = data[np.repeat(begin[mine] - stop + count, count) + np.arange(stop[-1])]
            # equal segments stand once, with their number
            _, one, of, times = np.unique(flat.mix(flat.Hasher(local)(stop - count, stop) ^ anchors[mine]), return_index=True, return_inverse=True, return_counts=True)
            by = np.argsort(one)
            one, times, of = one[by], times[by], np.argsort(by)[of]
            count = count[one]
            ends = np.cumsum(count)
            local = local[np.repeat((stop[one] - ends), count) + np.arange(ends[-1])]
            head = ends - count
            found = repeated(local, count, times, length)
            segment = np.searchsorted(head, found, "right") - 1
            edge = np.append(True, (found[1:] != found[:-1] + 1) | (segment[1:] != segment[:-1]))[: len(found)]
            first, end, of_span = found[edge], found[np.append(edge[1:], True)[: len(found)]], segment[edge]
            # to all texts that have the segment
            spans = np.bincount(of_span, minlength=len(one))
            each = spans[of]
            which = np.repeat((np.cumsum(spans) - spans)[of] - np.cumsum(each) + each, each) + np.arange(each.sum())
            base = np.repeat(at[mine], each) - head[of_span[which]]
            out_key.append(np.repeat(keys[mine], each))
            out_a.append(first[which] + base)
            out_b.append(end[which] + base + length)
        return pa.table({"key": np.concatenate(out_key), "a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return rows.groupBy("to").applyInArrow(run, "key long, a long, b long")


def dedup(docs: DataFrame, text: str = "text", length: int = LENGTH, give_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row (with ``give_text`` also kept_text, binary, as cuts can split a character).

    Matches never cross texts and may overlap themselves. Null and empty texts have no bytes; texts
    shorter than ``length`` lose none; rows with one text all lose all of it if it is as long as
    that. Null and repeated ids are no matter: rows count by their text. Other columns aren't read.
    ``length`` must be a multiple of 8 and more than 16.
    """
    if length % SYMBOL or length <= ANCHOR:
        raise ValueError("length must be a multiple of 8 above 16")
    texts = _texts(docs, text)
    sizes = texts.groupBy("__key").agg(F.count("*").alias("k"), F.max(F.octet_length("__text")).alias("n"))
    total = texts.agg(F.sum(F.octet_length("__text")).alias("n")).first().n or 0
    bits = min(MOST_BITS, max(16, int(total // 90).bit_length() + 4))
    buckets = max(64, int(total // (6 << 20)))
    table = repeated_anchors(texts, bits, length)
    found = covered(sent(texts, table, bits, buckets, length), length)
    copies = sizes.where((F.col("k") > 1) & (F.col("n") >= length)).select(F.col("__key").alias("key"), F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("b"))
    spans = kept(found.union(copies)).groupBy(F.col("key").alias("__key")).agg(F.collect_list("a").alias("__a"), F.collect_list("b").alias("__b"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in flat.pieces(batches, "__text"):
            buf, off = flat.flat(piece.column("__text"))
            n = piece.num_rows
            depth = np.zeros(len(buf) + 1, np.int64)
            for name, sign in (("__a", 1), ("__b", -1)):
                lists = piece.column(name)
                flatten, which = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                np.add.at(depth, flatten + np.repeat(off[:-1], which), sign)
            gone = np.cumsum(depth)[:-1] > 0
            starts, _ = flat.runs(gone, off)
            kept_bytes = [buf[a:b][~gone[a:b]].tobytes() for a, b in zip(off, off[1:], strict=False)]
            lost = np.concatenate([[0], np.cumsum(gone)])
            row = {"doc_id": piece.column("doc_id"), "n_bytes": np.diff(off), "n_removed": (lost[off[1:]] - lost[off[:-1]]).astype(np.int64), "n_spans": np.bincount(flat.owner(off, starts), minlength=n).astype(np.int64), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept_bytes])}
            yield flat.table(row | ({"kept_text": pa.array(kept_bytes, pa.binary())} if give_text else {}))

    return texts.join(spans, "__key", "left").select("doc_id", "__text", "__a", "__b").mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * give_text)
