"""Toxicity: a factorization machine over hashed terms.

A text's features are the hashed terms it holds, each once. The model adds a weight for each term
and, for each pair of terms, the product of their factor vectors, so that two terms which mean
little alone can count together. score = 1 / (1 + exp(-(bias + weights + interactions))).

Every one of the 2 to the ``BITS`` slots has a weight and a factor vector: no term is screened out
beforehand, since one that says nothing alone may decide in a pair. Steps are proximal: a weight that
the loss doesn't hold up goes to 0 (``LASSO``), and so does a whole factor vector (``GROUP_LASSO``).
Interactions count by one over the root of a text's number of terms, as their number grows with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .sample import labelled

BITS, FACTORS = 18, 8
#: Shrinkage of weights and factor vectors, over the root of the number of texts.
LASSO, GROUP_LASSO = 0.04, 0.12
#: Texts seen in training, over all epochs, and the bounds of the number of epochs.
VISITS, EPOCHS = 100_000, (5, 30)
TERM = flat.WORD.copy()
TERM[[c for c in range(128) if not chr(c).isalnum()]] = False


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed terms of each text, as (text, term) sorted. A term is a run of letters, digits or bytes beyond ASCII, A-Z in lower case."""
    buf, off = flat.flat(texts)
    buf = flat.LOWER[buf]
    starts, ends = flat.runs(TERM[buf], off)
    hashed = flat.Hasher(buf)(starts, ends) >> np.uint64(64 - BITS)
    both = np.unique((flat.owner(off, starts).astype(np.uint64) << np.uint64(BITS)) | hashed)
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Machine:
    """weights and factors by slot of the hash; slots that no sample text has stand for nothing and are 0."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def margin(self, doc: np.ndarray, term: np.ndarray, n: int, pairs: bool = True) -> np.ndarray:
        """term: the slots that occur in texts 0 to n - 1, by text; without ``pairs``, bias and weights only."""
        out = self.bias + np.bincount(doc, self.weights[term], n)
        half = 0.5 / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
        for v in self.factors.T if pairs else ():
            x = v[term].astype(float)
            out += half * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return out


def fit(doc: np.ndarray, term: np.ndarray, label: np.ndarray, rate: float = 0.3, seed: int = 7, factors: int = FACTORS) -> Machine:
    """Proximal AdaGrad on the logistic loss of the machine, in batches of texts. (doc, term) are sorted by text; texts without a term move the bias alone."""
    n, positive = len(label), float(label.sum())
    weight = float(np.clip((n - positive) / max(positive, 1.0) / 2, 1.0, 3.0))  # a rare label counts for more
    bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    out = Machine(bias, np.zeros(1 << BITS), np.zeros((1 << BITS, factors), np.float32))
    if not n or not 0 < positive < n:
        return out
    slots, rows = np.unique(term, return_inverse=True)  # only slots that occur are stepped
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(slots)), rng.normal(0, 0.1, (len(slots), factors)).astype(np.float32)
    first = np.searchsorted(doc, np.arange(n + 1))
    half = 0.5 / np.sqrt(np.maximum(np.diff(first), 1))
    lasso, group = LASSO / np.sqrt(n), GROUP_LASSO / np.sqrt(n)
    gw, gv, gb = np.full(len(slots), 1e-4), np.full((len(slots), factors), 1e-4, np.float32), 1e-2
    for _ in range(int(np.clip(VISITS // n, *EPOCHS))):
        order = rng.permutation(n)
        for a in range(0, n, 256):
            part = order[a : a + 256]
            part = np.append(part[first[part + 1] > first[part]], part[first[part + 1] == first[part]])
            size, s = first[part + 1] - first[part], half[part]
            full = int(np.count_nonzero(size))
            heads = np.cumsum(size) - size
            at = rows[np.repeat(first[part] - heads, size) + np.arange(size.sum())]
            d = np.repeat(np.arange(len(part)), size)
            by = np.argsort(at, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(at[by]) > 0)) if len(by) else by
            used = at[by[cut]]
            z, x = np.full(len(part), bias), v[at]
            total = np.zeros((len(part), factors), np.float32)
            if full:
                total[:full] = np.add.reduceat(x, heads[:full])
                z[:full] += np.add.reduceat(w[at], heads[:full]) + s[:full] * (total[:full] ** 2 - np.add.reduceat(x * x, heads[:full])).sum(1)
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[part]) * np.where(label[part] > 0, weight, 1.0) / len(part)
            if full:
                g = np.add.reduceat(off[d[by]], cut)
                gw[used] += g**2
                step = rate / np.sqrt(gw[used])
                u = w[used] - step * g
                w[used] = np.sign(u) * np.maximum(np.abs(u) - step * lasso, 0)
                g = np.add.reduceat((2 * off * s).astype(np.float32)[d[by], None] * (total[d[by]] - x[by]), cut)
                gv[used] += g**2
                step = rate / np.sqrt(gv[used])
                u = v[used] - step * g
                v[used] = u * np.maximum(1 - step.mean(1, keepdims=True) * group / (np.sqrt((u**2).sum(1, keepdims=True)) + 1e-12), 0) if factors else u
            gb += (g := float(off.sum())) ** 2
            bias -= rate * g / np.sqrt(gb)
    out.bias, out.weights[slots], out.factors[slots] = bias, w, v
    return out


def train(docs: DataFrame, labels: DataFrame, train_rows: object = None, text: str = "text", sample: int = 20_000) -> Machine:
    """Fits on at most ``sample`` labelled documents (the bound) that meet ``train_rows``; without both labels, a constant."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in flat.pieces(batches, text):
            doc, term = terms(piece.column(text))
            cut = np.searchsorted(doc, np.arange(piece.num_rows + 1))
            term = term.astype(np.int32)
            yield flat.table({"toxic": piece.column("toxic"), "terms": pa.array([term[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())})

    rows = labelled(docs, labels, "toxic", sample, train_rows, text).select(text, "toxic").mapInArrow(hashed, "toxic int, terms binary").toArrow()
    rows = rows.sort_by([("terms", "ascending"), ("toxic", "ascending")])  # one order, however the rows are dealt
    each = [np.frombuffer(b, np.int32) for b in rows.column("terms").to_pylist()]
    doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
    return fit(doc, np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64), rows.column("toxic").to_numpy().astype(float))


def toxicity(docs: DataFrame, machine: Machine, text: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= ``least``) and n_terms, a row for each row of ``docs``.

    A null, empty or blank text has no terms, and the bias alone as its score. Null ids stay null;
    repeated rows give repeated rows. Only doc_id and the text are read.
    """
    slots = np.flatnonzero((machine.weights != 0) | (machine.factors != 0).any(1))
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, slots, machine.weights[slots].astype(np.float32), machine.factors[slots].astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, weights, factors = shared.value
        model = Machine(bias, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, factors.shape[1]), np.float32))
        model.weights[at], model.factors[at] = weights, factors
        for piece in flat.pieces(batches, "__text"):
            doc, term = terms(piece.column("__text"))
            n = piece.num_rows
            p = 1 / (1 + np.exp(-np.clip(model.margin(doc, term, n), -40, 40)))
            yield flat.table({"doc_id": piece.column("doc_id"), "score": p, "predicted": (p >= least).astype(np.int32), "n_terms": np.bincount(doc, minlength=n).astype(np.int64)})

    return docs.select("doc_id", F.col(text).alias("__text")).mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, n_terms long")
