"""Token counts: greedy longest-match word pieces, counted in one pass without building them.

The vocabulary is a trie. Where a node has no child for the next byte, its failure link leads to
the node for what is left after the longest pieces are cut from its front, and its count says how
many pieces that cuts. So each byte is read once. Distinct words run side by side, a byte a step.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat


class Automaton:
    """edges: sorted node * 256 + byte; to: the child of each; fail, popped: by node (-1: the word can't be cut)."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        token, parent, byte = [False], [-1], [-1]
        for piece in sorted(set(pieces)):
            at = 0
            for b in piece:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    token.append(False)
                    parent.append(at)
                    byte.append(b)
                at = children[at][b]
            token[at] = bool(piece)
        n = len(children)
        fail, popped = [-1] * n, [0] * n
        level = list(children[0].values())
        while level:
            for v in level:
                if token[v]:
                    fail[v], popped[v] = 0, 1
                else:
                    z, k = fail[parent[v]], popped[parent[v]]
                    while z >= 0 and byte[v] not in children[z]:
                        z, k = fail[z], k + popped[z]
                    if z >= 0:
                        fail[v], popped[v] = children[z][byte[v]], k
            level = [c for v in level for c in children[v].values()]
        pairs = np.array([(v * 256 + b, c) for v, kids in enumerate(children) for b, c in kids.items()], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.edges, self.to = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)
        first = np.full(256, -1, np.int64)
        for b, c in children[0].items():
            first[b] = c
        self.first = first

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = np.where(node == 0, self.first[byte], -1)
        deep = np.flatnonzero(node > 0)
        if len(deep):
            key = node[deep] * 256 + byte[deep]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            out[deep] = np.where(self.edges[at] == key, self.to[at], -1)
        return out

    def count(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: bytes = b"") -> np.ndarray:
        """How many pieces each word, with ``lead`` before it, is cut into; 1 (the unknown piece) where it can't be cut."""
        order = np.argsort(starts - ends, kind="stable")
        starts, length = starts[order], (ends - starts)[order]
        node, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        longest = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(longest), "left")
        for t in range(-len(lead), longest + 1):
            k = len(starts) if t < 0 else active[t] if t < longest else 0
            if not k:
                break
            byte = np.full(k, lead[t + len(lead)], np.int64) if t < 0 else buf[starts[:k] + t].astype(np.int64)
            todo = np.flatnonzero(node[:k] >= 0)
            while len(todo):
                to = self.child(node[todo], byte[todo])
                node[todo[to >= 0]] = to[to >= 0]
                todo = todo[to < 0]
                n[todo] += self.popped[node[todo]]
                node[todo] = self.fail[node[todo]]
                todo = todo[node[todo] >= 0]
        todo = np.flatnonzero(node > 0)
        while len(todo):  # what is left at the end is cut as well
            n[todo] += self.popped[node[todo]]
            node[todo] = self.fail[node[todo]]
            todo = todo[node[todo] > 0]
        out = np.empty_like(n)
        out[order] = np.where(node < 0, 1, n)
        return out


_automata: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """From a file of base64 pieces, a piece a line."""
    if path not in _automata:
        with open(path, "rb") as f:
            _automata[path] = Automaton([base64.b64decode(line.split()[0]) for line in f if line.strip()])
    return _automata[path]


def piece_counts(docs: DataFrame, path: str, text: str = "text", lead: bytes = b" ") -> DataFrame:
    """doc_id, n_words, n_pieces and longest (most pieces in a word) for each row.

    Words are runs without blanks, A-Z in lower case; each is cut with ``lead`` before it. Null,
    empty and blank texts have none. Repeated rows give repeated rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for piece in flat.pieces(batches, "__text"):
            buf, off = flat.flat(piece.column("__text"))
            buf = flat.LOWER[buf]
            starts, ends = flat.runs(flat.WORD[buf], off)
            doc = flat.owner(off, starts)
            _, first, back = np.unique(flat.Hasher(buf)(starts, ends), return_index=True, return_inverse=True)
            n = a.count(buf, starts[first], ends[first], lead)[back]
            longest = np.zeros(piece.num_rows, np.int64)
            np.maximum.at(longest, doc, n)
            yield flat.table({"doc_id": piece.column("doc_id"), "n_words": np.bincount(doc, minlength=piece.num_rows), "n_pieces": flat.sums(n, doc, piece.num_rows), "longest": longest})

    return docs.select("doc_id", F.col(text).alias("__text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_pieces long, longest long")
