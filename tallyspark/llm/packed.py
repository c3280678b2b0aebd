"""Token ids as files of Simple-8b words.

A 64-bit word has a selector in its top 4 bits and in the other 60 as many ids as its selector says, each of as many
bits as it says: the most that fit are taken. An id of more than 60 bits is an escape: its word holds the place of the
id in the file's list of escapes, so that the top bits of every word are a selector and words can be decoded in any order.
Words are cut into blocks of ``BLOCK`` ids, and the file has the word at which each block begins: blocks are
coded side by side, one word of each a step, and decoded all at once, selector by selector.

A file (little-endian): ``MAGIC``, then as 64-bit numbers the documents, ids, words, escapes, bytes of names, words of
lengths, escapes of lengths, shard and the shard's ids before this file; then the word where each block begins (32 bits
each), words, escapes, the documents' numbers of ids (coded alike, blocks and all), the lengths of names + 1 (32 bits each, 0: a null
doc_id) and the names. Files are written by Spark as rows of a table in the shared folder, so that a lost executor leaves no
half of one; ``export`` writes them out one by one.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .store import kept

MAGIC = b"TLS8B\x00\x00\x01"
HEAD = struct.Struct("<8s9Q")
BLOCK = 1024
#: Ids after which a file ends with the document at hand.
FILE_IDS = 1 << 20
#: Ids in a word and bits of each, by selector. Fixed values of the code; 0 is an escape, 15 isn't used.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0])
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
#: The least numbers of more than 0, 1, 2, .. bits.
LIMITS = np.array([1 << b for b in range(61)], np.uint64)
#: Words after which a worker forgets those it had not met since the last time; the longest (characters) that it remembers.
REMEMBER, LONGEST = 600_000, 64
#: Bytes of texts that are cut into words at a time.
PIECE = 4 << 20
#: Blanks never stand in a token, and letters are never in one with the marks that end a word: texts may be cut there.
MARKS = ".,;:!?"
MARKED = rf"^[A-Za-zÀ-ÖØ-öø-įı-ƿ]+[{MARKS}]*$"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word at which each block begins, the words and the escapes of ``ids`` (whole numbers from 0 to 2^64 - 1)."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    escapes = np.zeros(0, np.uint64)
    if int(ids.max()) >> 60:
        escaped = np.flatnonzero(ids >> np.uint64(60))
        escapes, ids = ids[escaped].astype(np.uint64), ids.copy()
        ids[escaped] = np.arange(len(escapes), dtype=ids.dtype)
    size = np.searchsorted(LIMITS, ids, "right").astype(np.uint8)
    if len(escapes):
        size[escaped] = 255
    # after each block stand 64 places that any word may take in
    wide = np.zeros((blocks, BLOCK + 64), np.uint8)
    wide[:, :BLOCK].reshape(-1)[:n] = 0
    wide[: n // BLOCK, :BLOCK] = size[: n // BLOCK * BLOCK].reshape(-1, BLOCK)
    wide[n // BLOCK :, : n % BLOCK] = size[n // BLOCK * BLOCK :]
    wide = wide.reshape(-1)
    widest = {1: wide}  # the most bits among the next 1, 2, 4, .. ids
    for k in (1, 2, 4, 8, 16):
        widest[2 * k] = np.maximum(widest[k], np.append(widest[k][k:], np.zeros(k, np.uint8)))
    selector = np.zeros(len(wide), np.uint8)
    for s in range(14, 0, -1):  # more ids of fewer bits take the place of what was found before
        count, half = int(COUNTS[s]), 1 << (int(COUNTS[s]).bit_length() - 1)
        most = widest[half]
        if count > half:
            most = np.maximum(most, np.append(most[count - half :], np.zeros(count - half, np.uint8)))
        selector[most <= BITS[s]] = s
    row = np.arange(blocks) * (BLOCK + 64)
    end = row + np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    at, block, starts, of = row, np.arange(blocks), [], []
    while len(at):  # a word of every block a step
        starts.append(at)
        of.append(block)
        at = at + COUNTS[selector[at]]
        going = at < end[block]
        at, block = at[going], block[going]
    start, of = np.concatenate(starts), np.bincount(np.concatenate(of))
    start.sort()
    chosen = selector[start]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.zeros((blocks, BLOCK + 64), np.uint64)
    padded[: n // BLOCK, :BLOCK] = ids[: n // BLOCK * BLOCK].reshape(-1, BLOCK)
    padded[n // BLOCK :, : n % BLOCK] = ids[n // BLOCK * BLOCK :]
    padded = padded.reshape(-1)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        from_ = start[mine]
        for k in range(COUNTS[s]):
            words[mine] |= padded[from_ + k] << np.uint64(k * BITS[s])
    return (np.cumsum(of) - of).astype(np.uint32), words, escapes


def unpack(n: int, begins: np.ndarray, words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ``n`` ids again."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    if not COUNTS[selector].all():
        raise ValueError("a word with a selector that the code doesn't have")
    counts = COUNTS[selector]
    block = np.repeat(np.arange(len(begins)), np.diff(np.append(begins.astype(np.int64), len(words))))
    first = np.cumsum(counts) - counts
    start = first - first[begins.astype(np.int64)][block] + block * BLOCK
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        ids = (words[mine, None] >> (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
        if s == 0:
            ids = escapes[ids]
        to = start[mine, None] + np.arange(COUNTS[s])
        good = to < np.minimum((block[mine] + 1) * BLOCK, n)[:, None]
        out[to[good]] = ids[good]
    return out


def image(ids: np.ndarray, lengths: np.ndarray, names: list[str | None], shard: int = 0, before: int = 0) -> bytes:
    """A file of documents: their ids one after another, how many each has, and their doc_ids as text."""
    begins, words, escapes = pack(ids)
    l_begins, l_words, l_escapes = pack(lengths)
    raw = [None if x is None else x.encode() for x in names]
    text = b"".join(x for x in raw if x)
    head = HEAD.pack(MAGIC, len(names), len(ids), len(words), len(escapes), len(text), len(l_words), len(l_escapes), shard, before)
    sizes = np.array([0 if x is None else len(x) + 1 for x in raw], np.uint32)
    return b"".join([head, *[x.tobytes() for x in (begins, words, escapes, l_begins, l_words, l_escapes, sizes)], text])


def header(data: bytes | pa.Buffer) -> tuple:
    """The fields of a file's head, ``MAGIC`` first."""
    if len(data) < HEAD.size or bytes(data[:8]) != MAGIC:
        raise ValueError("not a file of packed ids")
    return HEAD.unpack_from(data)


def opened(data: bytes) -> tuple[np.ndarray, np.ndarray, list[str | None], int, int]:
    """ids, lengths, names, shard and ids before it of a file."""
    _, docs, n, words, escapes, text, l_words, l_escapes, shard, before = header(data)
    at = HEAD.size

    def take(count: int, kind: type) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, np.dtype(kind).newbyteorder("<"), count, at)
        at += got.nbytes
        return got

    ids = unpack(n, take(-(-n // BLOCK), np.uint32), take(words, np.uint64), take(escapes, np.uint64))
    lengths = unpack(docs, take(-(-docs // BLOCK), np.uint32), take(l_words, np.uint64), take(l_escapes, np.uint64)).astype(np.int64)
    sizes = take(docs, np.uint32).astype(np.int64)
    ends = np.cumsum(np.maximum(sizes - 1, 0)) + at
    names = [None if s == 0 else data[e - s + 1 : e].decode() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    return ids, lengths, names, shard, before


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all runs of ``size`` from ``start``, one after another."""
    upto = np.cumsum(size, dtype=np.int64)
    return np.repeat(start - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


class Coder:
    """The library's ids of texts, word by word: none of this tokenizer's steps looks past a blank, and words repeat.

    Known words are an Arrow array, beside it where their ids stand in one flat array; a batch's different words are looked up at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has its own tasks
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        if not suffix:
            raise ValueError("a tokenizer whose words have no ends of their own")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.words = pa.array([], pa.string())
        self.ids, self.start, self.size, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and how many each has."""
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, np.uint32), np.array([len(i) for i in found], np.int64)

    def _in_rows(self, words: list[str], pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of letters and the marks after them, many in a row: letters are one piece, marks another, and a piece ends with the one token of it that ends a word."""
        ids, _ = self._library([" ".join(words[i : i + 500]) for i in range(0, len(words), 500)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != pieces.sum():  # some word has more
            return self._library(words)
        return ids, np.diff(ends[np.cumsum(pieces) - 1], prepend=0)

    def learned(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of new words, and where each word's start and how many they are."""
        plain = pc.match_substring_regex(new, MARKED).to_numpy(zero_copy_only=False)
        pieces = pc.match_substring_regex(new, f"[{MARKS}]$").to_numpy(zero_copy_only=False) + 1
        start, size, parts, held = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [np.zeros(0, np.uint32)], 0
        for mine, step in ((np.flatnonzero(plain), 50_000), (np.flatnonzero(~plain), 5_000)):
            for i in range(0, len(mine), step):
                some = mine[i : i + step]
                words = new.take(pa.array(some)).to_pylist()
                ids, n = self._in_rows(words, pieces[some]) if plain[some[0]] else self._library(words)
                start[some], size[some] = held + np.cumsum(n) - n, n
                parts.append(ids)
                held += len(ids)
        return np.concatenate(parts), start, size

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end`` after it, and how many each has."""
        cut = pc.ascii_split_whitespace(texts)
        off = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        words = cut.flatten().dictionary_encode()
        every, index = words.dictionary, words.indices.to_numpy()
        at = pc.index_in(every, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        old = at >= 0
        self.used[at[old]] = True
        new = every.filter(pa.array(~old))
        ids, start, size = self.learned(new)
        ids = np.concatenate([self.ids, ids, np.array([end], np.uint32)])
        starts, sizes = np.append(np.zeros(len(every), np.int64), len(ids) - 1), np.append(np.zeros(len(every), np.int64), 1)  # a text's end stands as a word of its own
        starts[:-1][old], sizes[:-1][old] = self.start[at[old]], self.size[at[old]]
        starts[:-1][~old], sizes[:-1][~old] = start + len(self.ids), size
        self._remember(new, ids, starts[:-1][~old], size)
        index = np.insert(index, off[1:], len(every))
        each = sizes[index]
        upto = np.concatenate([[0], np.cumsum(each)])
        return ids[_spread(starts[index], each)], np.diff(upto[off[1:] + np.arange(1, len(off))], prepend=0)

    def _remember(self, new: pa.Array, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Adds new words, but for very long ones; when there are too many, those that no batch has had since the last time go."""
        short = pc.less_equal(pc.utf8_length(new), LONGEST)
        keep = short.to_numpy(zero_copy_only=False)
        self.words = pa.concat_arrays([self.words, new.filter(short)])
        self.ids = np.concatenate([self.ids, ids[_spread(start[keep], size[keep])]])
        self.size = np.concatenate([self.size, size[keep]])
        self.used = np.append(self.used, np.zeros(int(keep.sum()), bool))
        if len(self.words) > REMEMBER:
            stay = self.used if self.used.sum() <= REMEMBER // 2 else np.zeros(len(self.used), bool)
            self.words = self.words.filter(pa.array(stay))
            self.ids = self.ids[_spread((np.cumsum(self.size) - self.size)[stay], self.size[stay])]
            self.size, self.used = self.size[stay], np.zeros(int(stay.sum()), bool)
        self.start = np.cumsum(self.size) - self.size


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def write(docs: DataFrame, path: str, end: int = 1, text: str = "text") -> DataFrame:
    """The files of the documents in ascending order of doc_id (null first): shard, file (its number in the shard), n (its ids) and content.

    Each document's ids end with ``end``; null and empty texts have that one only. Rows that share an id stand in
    the order of their texts' hashes; equal rows repeat. Documents are dealt to as many shards as the session has shuffle
    partitions, in ranges of their order; a row's place breaks ties, so equal rows can be split as well. Other columns aren't read.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("__text"), F.col("__row")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.col("doc_id").cast("string").alias("doc_id"), "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, shard, before, file = coder(path), TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        names: list[str | None] = []
        held = 0

        def written() -> pa.RecordBatch:
            nonlocal before, file, held
            out = image(np.concatenate(ids), np.concatenate(lengths), names, shard, before)
            row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "file": pa.array([file], pa.int64()), "n": pa.array([held], pa.int64()), "content": pa.array([out], pa.binary())})
            before, file, held = before + held, file + 1, 0
            ids.clear(), lengths.clear(), names.clear()
            return row

        for piece in flat.pieces(batches, "__text", PIECE):
            got, sizes = c.encode(piece.column("__text"), end)
            ids.append(got)
            lengths.append(sizes)
            names += piece.column("doc_id").to_pylist()
            held += len(got)
            if held >= FILE_IDS:
                yield written()
        if names:
            yield written()

    return kept(rows.mapInArrow(run, "shard long, file long, n long, content binary"))


def read_back(files: DataFrame, kind: str = "long") -> DataFrame:
    """doc_id (of type ``kind``), start, n_tokens and ids_crc32 of each document, from ``content`` of files alone.

    start: the ids of all documents of the shards and files before it; one number for each shard is sent to
    all tasks, as many as the files were written in tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                ids, lengths, names, shard, before = opened(content.as_buffer().to_pybytes())
                if len(ids) and ids.max() >> np.uint64(32):
                    raise ValueError("an id of more than 32 bits has no digest of 32-bit numbers")
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names, pa.string()), "shard": np.full(len(names), shard, np.int64), "at": before + ends - lengths, "n_tokens": lengths, "ids_crc32": pa.array(crc, pa.int64())})
        flat.release()

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [header(c.as_buffer()) for c in batch.column("content")]
            yield pa.RecordBatch.from_pydict({"shard": pa.array([h[8] for h in heads], pa.int64()), "n": pa.array([h[2] for h in heads], pa.int64())})

    # a number for each shard, summed on the driver: shards are tasks
    listed = files.select("shard", "n") if {"shard", "n"} <= set(files.columns) else files.select("content").mapInArrow(totals, "shard long, n long")
    sums = sorted(listed.groupBy("shard").agg(F.sum("n").alias("n")).collect())
    starts, upto = [], 0
    for shard, n in sums:
        starts.append((shard, upto))
        upto += n
    before = F.broadcast(files.sparkSession.createDataFrame(starts, "shard long, before long"))
    rows = files.select("content").mapInArrow(run, "doc_id string, shard long, at long, n_tokens long, ids_crc32 long")
    return rows.join(before, "shard").select(F.col("doc_id").cast(kind).alias("doc_id"), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def ids(files: DataFrame, kind: str = "long") -> DataFrame:
    """doc_id and ids (array of long) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found, lengths, names, _, _ = opened(content.as_buffer().to_pybytes())
                off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names, pa.string()), "ids": pa.ListArray.from_arrays(off, found.astype(np.int64))})

    return files.select("content").mapInArrow(run, "doc_id string, ids array<long>").select(F.col("doc_id").cast(kind).alias("doc_id"), "ids")


def export(files: DataFrame, folder: str) -> DataFrame:
    """Writes each file to ``folder`` (a path or address that pyarrow's file systems know, shared by all executors) as <shard>-<file>.ids and gives path and bytes of each.

    A file is written under another name and then renamed, so a task that is run again leaves whole files only. ``load`` reads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for shard, file, content in zip(batch.column("shard").to_pylist(), batch.column("file").to_pylist(), batch.column("content"), strict=True):
                to = f"{root}/{shard:06d}-{file:06d}.ids"
                part = f"{root}/_{shard:06d}-{file:06d}-{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                system.move(part, to)
                yield pa.RecordBatch.from_pydict({"path": [to], "bytes": pa.array([len(content.as_buffer())], pa.int64())})

    return kept(files.select("shard", "file", "content").mapInArrow(run, "path string, bytes long"))


def load(spark: SparkSession, folder: str) -> DataFrame:
    """``content`` of the files that ``export`` wrote."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "content")
