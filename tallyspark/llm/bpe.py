"""BPE encoding and decoding by batched NumPy merge rounds.

The symbols of many words stand in one flat array. A round looks up every neighbouring pair by
binary search over the sorted pair keys of the vocabulary, takes each word's lowest rank, and
merges that pair wherever it stands in the word, from left to right; rounds go on for the words
that still have a pair. Words repeat, so a worker keeps what it has encoded, up to ``REMEMBER``
bytes of words and ids; words above ``LONGEST`` characters aren't kept.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat

#: The pattern that splits a text before the merges, fixed by the tokenizer's format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBER, LONGEST = 4 << 20, 64


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself where printable, else one from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {chr(b): b for b in shown}
    return names | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


class Vocabulary:
    """A byte-level BPE vocabulary from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        ids, names = j["model"]["vocab"], byte_names()
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(names[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in names.items():
            self.of_byte[b] = ids[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        left, right = np.array([ids[a] for a, _ in pairs], np.int64), np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.ranks, self.made = size, keys[order], order.astype(np.int64), made[order]
        self.text = [str(i).encode() for i in range(size)]
        self.text_flat = np.frombuffer(b",".join(self.text) + b",", np.uint8)
        self.text_size = np.array([len(t) + 1 for t in self.text])
        self.text_start = np.cumsum(self.text_size) - self.text_size

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (none empty) one after another, and the n + 1 offsets of the words in them."""
        buf = np.frombuffer(b"".join(words), np.uint8)
        symbols, word = self.of_byte[buf], np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        never = np.int64(1 << 40)
        rank, at = np.full(len(symbols), never), np.zeros(len(symbols), np.int64)
        fresh = np.flatnonzero(word[:-1] == word[1:])  # places whose pair has yet to be looked up
        while len(symbols):
            key = symbols[fresh] * self.size + symbols[fresh + 1]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            at[fresh], rank[fresh] = found, np.where(self.keys[found] == key, self.ranks[found], never)
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, heads)
            live = np.repeat(lowest < never, np.diff(np.append(heads, len(symbols))))
            lowest = np.repeat(lowest, np.diff(np.append(heads, len(symbols))))
            if not live.all():  # words without a pair are ready
                done.append((word[~live], symbols[~live]))
                if not live.any():
                    break
            places = np.flatnonzero((rank == lowest) & live)
            # of neighbouring hits, which only equal symbols give, every second one from the left of the run
            head = np.append(True, np.diff(places) > 1)
            places = places[(places - places[head][np.cumsum(head) - 1]) % 2 == 0]
            symbols[places] = self.made[at[places]]
            keep = live.copy()
            keep[places + 1] = False
            merged = np.zeros(len(symbols), bool)
            merged[places] = True
            symbols, word, rank, at, merged = symbols[keep], word[keep], rank[keep], at[keep], merged[keep]
            near = merged.copy()
            near[:-1] |= merged[1:]
            rank[near] = never
            near[:-1] &= word[:-1] == word[1:]
            near[-1:] = False
            fresh = np.flatnonzero(near)
        word, symbols = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        return symbols[np.argsort(word, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])

    def written(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as decimal text, joined by commas."""
        ids, off = self.merge(words)
        size = self.text_size[ids]
        ends = np.cumsum(size)
        out = self.text_flat[np.repeat(self.text_start[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()
        cut = np.append(0, ends)[off].tolist()
        return [out[a : b - 1] for a, b in zip(cut, cut[1:], strict=False)]


class Coder:
    """Encodes and decodes texts; what it remembers is bounded."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.vocabulary.special, key=len, reverse=True)) + ")").split if self.vocabulary.special else lambda t: [t]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def words(self, text: str) -> list[str]:
        special = self.vocabulary.special
        if not any(s in text for s in special):
            return self.find(text)
        return [w for part in self.cut(text) for w in ([part] if part in special else self.find(part))]

    def encode_words(self, words: list[list[str]]) -> list[bytes]:
        """The ids of each text as decimal text, joined by commas."""
        known, v = self.known, self.vocabulary
        new = set(chain.from_iterable(words)) - known.keys()
        fresh = [w for w in new if w not in v.special]
        found = {w: v.text[v.special[w]] for w in new if w in v.special}
        if fresh:
            found.update(zip(fresh, v.written([w.encode() for w in fresh]), strict=True))
        known.update(found)
        out = [b",".join(map(known.__getitem__, ws)) for ws in words]
        for w, ids in found.items():
            if len(w) > LONGEST:
                del known[w]
            else:
                self.held += len(w) + len(ids)
        if self.held > REMEMBER:
            self.known, self.held = {}, 0
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.fromstring(b, np.int64, sep=",") if b else np.zeros(0, np.int64) for b in self.encode_words([self.words(t) for t in texts])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        of = self.vocabulary.bytes
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) for each row; null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for piece in flat.pieces(batches, "__text", flat.PIECE):
            ids = c.encode([t or "" for t in piece.column("__text").to_pylist()])
            off = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            yield flat.table({"doc_id": piece.column("doc_id"), "ids": pa.ListArray.from_arrays(off, np.concatenate(ids).astype(np.int32) if len(ids) else np.zeros(0, np.int32))})

    return docs.select("doc_id", F.col(text).alias("__text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """doc_id and text; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            yield flat.table({"doc_id": batch.column("doc_id"), "text": pa.array([c.decode(np.asarray(i or [], np.int64)) for i in batch.column("__ids").to_pylist()], pa.string())})

    return rows.select("doc_id", F.col(ids).alias("__ids")).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and same (decoding gave the text back) for each row.

    Texts are encoded, and decoded from their ids, whole; a null or empty text has no tokens and the
    digests of nothing. Repeated rows give repeated rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        by_text = dict(zip(c.vocabulary.text, c.vocabulary.bytes, strict=True))
        for piece in flat.pieces(batches, "__text", flat.PIECE):
            texts = [t or "" for t in piece.column("__text").to_pylist()]
            ids = c.encode_words([c.words(t) for t in texts])
            back = [b"".join(map(by_text.__getitem__, b.split(b","))).decode("utf-8", "replace") if b else "" for b in ids]
            yield flat.table({
                "doc_id": piece.column("doc_id"), "n_tokens": np.array([b.count(b",") + 1 if b else 0 for b in ids], np.int64),
                "ids_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in ids]), "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), "same": pa.array([a == b for a, b in zip(texts, back, strict=True)]),
            })

    return docs.select("doc_id", F.col(text).alias("__text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
