"""Quality rules: word counts and repetition of a text, and line labels from a linear-chain CRF.

Every line with a word gets one bin from each of the groups in ``GROUPS``. The conditional random
field has a weight for each bin and label, a start weight for each label and a weight for each
pair of neighbouring labels; Viterbi decoding marks each line as content (1) or boilerplate (0).
The share of a text's words that stand in content lines decides whether it is kept.

Line labels for training come from labels of documents: all lines of a good document are content,
those of a bad one boilerplate; after a first fit, lines of bad documents that their own bins say
are content change sides, and the model is fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import flat
from .sample import labelled

WINDOW = 5
#: The share of words in content lines from which a text is kept.
KEEP_SHARE = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_is = lambda a, b: (np.arange(256) >= ord(a)) & (np.arange(256) <= ord(b))
UPPER, DIGIT = _is("A", "Z"), _is("0", "9")
LETTER = UPPER | _is("a", "z") | (np.arange(256) >= 192)  # a character beyond ASCII counts by its lead byte
STOP = np.zeros(256, bool)
STOP[np.frombuffer(b".!?:;\"')", np.uint8)] = True
SHARES = (0.0, 0.01, 0.03, 0.08, 0.2, 0.5)
#: Upper bounds (inclusive) of the bins of each feature of a line; one more bin lies above.
GROUPS = {
    "words": (1, 2, 4, 8, 16, 40),
    "word_length": (2.5, 3.5, 4.5, 6, 8, 12),
    "symbols": SHARES,
    "bangs": SHARES,
    "upper": (0.0, 0.05, 0.1, 0.2, 0.4, 0.7),
    "digits": SHARES,
    "same_as_last": (0.0, 0.05, 0.2, 0.5),
    "in_repeats": (0.0, 0.1, 0.3, 0.6),
    "stops": (0.0,),
    "again": (0.0,),
}
_FIRST = np.cumsum([0, *(len(b) + 1 for b in GROUPS.values())])
N_BINS = int(_FIRST[-1])


def scan(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts for each text, and for each line with a word its text, words and bins."""
    buf, off = flat.flat(texts)
    n = len(off) - 1
    starts, ends = flat.runs(flat.WORD[buf], off)
    doc = flat.owner(off, starts)
    n_words = np.bincount(doc, minlength=n)
    whole = lambda member: np.add.reduceat(np.append(member, False).astype(np.int64), np.minimum(off[:-1], len(buf))) * (np.diff(off) > 0) if n else np.zeros(0, np.int64)
    hashed = flat.Hasher(buf)
    words = hashed(starts, ends)
    keys, first = flat.shingles(words, doc, WINDOW)
    keys = flat.mix(keys + doc[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(twice):
        at = first[np.isin(keys, twice)]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    covered = np.cumsum(covered)[:-1] > 0
    # lines
    begin, stop = flat.runs(buf != 10, off)
    line = np.searchsorted(begin, starts, "right") - 1
    has = np.bincount(line, minlength=len(begin)) > 0
    renumber = np.cumsum(has) - 1
    begin, stop, line = begin[has], stop[has], renumber[line]
    of = flat.owner(off, begin)
    text_of_line = flat.mix(hashed(begin, stop) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, firsts = np.unique(text_of_line, return_index=True)
    again = np.ones(len(begin), bool)
    again[firsts] = False
    m = len(begin)
    per_line = np.bincount(line, minlength=m).astype(float)

    def in_lines(member: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(member)])
        return (c[stop] - c[begin]).astype(float)

    chars = np.maximum(in_lines(((buf & 0xC0) != 0x80) & flat.WORD[buf]), 1)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
    last = ends[np.searchsorted(line, np.arange(m), "right") - 1] - 1 if m else np.zeros(0, np.int64)
    features = {
        "words": per_line, "word_length": chars / np.maximum(per_line, 1), "symbols": in_lines(SYMBOLS[buf]) / chars, "bangs": in_lines(buf == 33) / chars,
        "upper": in_lines(UPPER[buf]) / np.maximum(in_lines(LETTER[buf]), 1), "digits": in_lines(DIGIT[buf]) / chars,
        "same_as_last": np.bincount(line, same, m) / np.maximum(per_line, 1), "in_repeats": np.bincount(line, covered, m) / np.maximum(per_line, 1),
        "stops": STOP[buf[last]].astype(float), "again": again.astype(float),
    }
    bins = np.stack([np.searchsorted(np.asarray(b, float), features[k] - 1e-12) + _FIRST[i] for i, (k, b) in enumerate(GROUPS.items())], 1).astype(np.uint8) if m else np.zeros((0, len(GROUPS)), np.uint8)
    return {
        "n_words": n_words.astype(np.int64), "word_chars": whole(((buf & 0xC0) != 0x80) & flat.WORD[buf]), "n_symbols": whole(SYMBOLS[buf]),
        "n_dup_lines": np.bincount(of[again], minlength=n).astype(np.int64), "n_repeat_words": flat.sums(covered, doc, n),
        "line_doc": of, "line_words": per_line, "bins": bins,
    }


class Chain:
    """A linear-chain CRF with two labels over lines with binned features."""

    def __init__(self, weights: np.ndarray | None = None, start: np.ndarray | None = None, step: np.ndarray | None = None):
        self.weights = np.zeros((N_BINS, 2)) if weights is None else weights
        self.start = np.zeros(2) if start is None else start
        self.step = np.zeros((2, 2)) if step is None else step

    @staticmethod
    def _layout(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """rows[r, t]: the line number at place t of the sequence of rank r by falling length, or -1; active[t]: sequences longer than t."""
        _, first, length = np.unique(doc, return_index=True, return_counts=True)
        order = np.argsort(-length, kind="stable")
        return first[order], np.searchsorted(-length[order], -np.arange(1, (length.max() if len(length) else 0) + 1), "right"), len(length)

    def viterbi(self, bins: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The label of each line; lines of a text stand together. Ties go to content."""
        labels = np.ones(len(doc), np.int8)
        first, active, n = self._layout(doc)
        if not n:
            return labels
        unary = self.weights[bins].sum(1)
        best, back = unary[first] + self.start, np.zeros((len(doc), 2), np.int8)
        for t in range(1, len(active)):
            k = active[t]
            at = first[:k] + t
            paths = best[:k, :, None] + self.step
            choice = (paths[:, 1] >= paths[:, 0]).astype(np.int8)
            back[at] = choice
            best[:k] = np.where(choice == 1, paths[:, 1], paths[:, 0]) + unary[at]
        now = (best[:, 1] >= best[:, 0]).astype(np.int8)
        for t in range(len(active) - 1, -1, -1):
            at = first[: active[t]] + t
            labels[at] = now[: active[t]]
            now[: active[t]] = back[at, labels[at]]
        return labels

    def fit(self, bins: np.ndarray, doc: np.ndarray, labels: np.ndarray, steps: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> Chain:
        """Maximises the conditional likelihood of the labels by Adam on the exact gradient."""
        first, active, n = self._layout(doc)
        if not n:
            return self
        lines, moments, speeds = len(doc), [np.zeros_like(p) for p in (self.weights, self.start, self.step)], [np.zeros_like(p) for p in (self.weights, self.start, self.step)]
        truth = np.eye(2)[labels]
        for i in range(1, steps + 1):
            unary = self.weights[bins].sum(1)
            alpha, beta = np.zeros((lines, 2)), np.zeros((lines, 2))
            alpha[first] = unary[first] + self.start
            for t in range(1, len(active)):
                at = first[: active[t]] + t
                alpha[at] = np.logaddexp.reduce(alpha[at - 1][:, :, None] + self.step, 1) + unary[at]
            for t in range(len(active) - 1, 0, -1):
                at = first[: active[t]] + t
                beta[at - 1] = np.logaddexp.reduce(self.step + (unary[at] + beta[at])[:, None, :], 2)
            total = np.logaddexp.reduce(alpha + beta, 1)
            off = truth - np.exp(alpha + beta - total[:, None])
            later = np.ones(lines, bool)
            later[first] = False
            at = np.flatnonzero(later)
            pairs = np.exp(alpha[at - 1][:, :, None] + self.step + (unary[at] + beta[at])[:, None, :] - total[at][:, None, None])
            seen = (truth[at - 1][:, :, None] * truth[at][:, None, :]).sum(0)
            g = np.stack([np.bincount(bins.ravel(), np.repeat(off[:, y], bins.shape[1]), N_BINS) for y in (0, 1)], 1)
            for p, grad, mo, sp in zip((self.weights, self.start, self.step), (g / lines - ridge * self.weights, off[first].sum(0) / lines, (seen - pairs.sum(0)) / lines - ridge * self.step), moments, speeds, strict=True):
                mo *= 0.9
                mo += 0.1 * grad
                sp *= 0.99
                sp += 0.01 * grad**2
                p += rate * (mo / (1 - 0.9**i)) / (np.sqrt(sp / (1 - 0.99**i)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = 4000) -> Chain:
    """Fits on at most ``sample`` labelled documents (the bound); none, or one class only: a model that calls every line content."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in flat.pieces(batches, text):
            x = scan(piece.column(text))
            cut = np.searchsorted(x["line_doc"], np.arange(piece.num_rows + 1))
            yield flat.table({"doc_id": piece.column("doc_id"), "quality": piece.column("quality"), "bins": pa.array([x["bins"][a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())})

    chosen = labelled(docs, labels, "quality", sample, text=text)
    rows = chosen.mapInArrow(lines, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, quality int, bins binary").toArrow().sort_by("doc_id")
    good = rows.column("quality").to_numpy()
    each = [np.frombuffer(b, np.uint8).reshape(-1, len(GROUPS)) for b in rows.column("bins").to_pylist()]
    if not each or len(set(good.tolist())) < 2:
        return Chain()
    bins, doc = np.concatenate(each), np.repeat(np.arange(len(each)), [len(b) for b in each])
    truth = good[doc].astype(np.int64)
    model = Chain().fit(bins, doc, truth)
    alone = model.weights[bins].sum(1)
    own = np.where((truth == 0) & (alone[:, 1] - alone[:, 0] > 1.0), 1, truth)
    return Chain().fit(bins, doc, own) if (own == 0).any() else model


def quality(docs: DataFrame, model: Chain, text: str = "text", keep_share: float = KEEP_SHARE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the columns in ``carry``, the counts, base_failed, content_share and kept.

    A null or empty text, or one of blanks only, has no words: all counts 0, base_failed true,
    content_share 0, kept false. Rows that repeat, and ids that are null or repeat, each get a row.
    Columns of ``docs`` that ``carry`` doesn't name are dropped; those it names must not be named as
    the columns that are added.
    """
    names = ["doc_id", *(c for c in carry if c != "doc_id")]
    own = text if text in names else "__text"
    weights, start, step = model.weights, model.start, model.step

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(weights, start, step)
        for piece in flat.pieces(batches, own):
            x = scan(piece.column(own))
            label = chain.viterbi(x["bins"], x["line_doc"])
            n = piece.num_rows
            content = np.bincount(x["line_doc"], x["line_words"] * label, n)
            share = content / np.maximum(x["n_words"], 1)
            failed = (x["n_words"] < 10) | (100 * x["n_repeat_words"] > 20 * x["n_words"])
            yield flat.table({c: piece.column(c) for c in names} | {k: x[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": failed, "content_share": share, "kept": ~failed & (share >= keep_share)})

    fields = [docs.schema[c] for c in names]
    rows = docs.select(*names) if own == text else docs.select(*names, F.col(text).alias("__text"))
    return rows.mapInArrow(score, StructType([*fields, *StructType.fromDDL("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")]))
