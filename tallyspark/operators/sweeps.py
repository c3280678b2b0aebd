"""Many multinomial logistic models fitted side by side: layers, splits and caps in the same passes (PRB01-PRB07, QRY33).

Rows are packed into blocks of ``ROWS``: a matrix of all their vectors, their labels and the flags that say which models
train or test on them. A pass is one job over the blocks. It adds up, for every model that isn't done, the loss, the
gradient and, if asked, the Hessian of its training rows, in each task and then by tree, so what is shuffled depends on
tasks and parameters and not on rows. The driver holds the state of each model's solver, which asks for the next
point: L-BFGS, or Newton's method with the exact Hessian. Models are done one by one; a pass costs those that are left.

The loss is the mean log loss plus l2 / (2 n) times the squared weights over n training rows; intercepts are free. Vectors
are standardised with the training rows' own means and population deviations + 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 2048
#: Partial sums that one task adds up.
FAN = 32
#: Parameters of all models together that the driver holds, and of one model's Hessian.
STATE, HESSIAN = 20_000_000, 4_000


@dataclass(frozen=True)
class Model:
    """vec and the flags of its training and test rows, by name; steps: the cap on iterations."""

    name: str
    vec: str
    train: str
    test: str
    steps: int = 200


@dataclass
class Fitted:
    """weights (dimensions + 1 rows, the last for intercepts), what they were fitted on, and how the fit went."""

    weights: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    n_train: int
    iterations: int = 0
    passes: int = 0
    capped: bool = False
    loss_before: float = 0.0
    loss_after: float = 0.0
    gradient: float = 0.0


class Lbfgs:
    """Limited-memory quasi-Newton steps with backtracking. ``point`` is where it wants the loss and gradient next; ``tell`` gives them."""

    hessian = False

    def __init__(self, start: np.ndarray, steps: int, tolerance: float, memory: int = 10):
        self.point, self.steps, self.tolerance, self.memory = start, steps, tolerance, memory
        self.at: np.ndarray | None = None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.taken = self.asked = 0
        self.done = False

    def tell(self, loss: float, gradient: np.ndarray, _: np.ndarray | None = None) -> None:
        self.asked += 1
        if self.at is None:
            self.first = loss
        elif not loss <= self.loss + 1e-4 * self.scale * self.slope + 1e-15 * abs(self.loss):
            self.scale /= 2
            if self.scale < 1e-12:
                self.done = True
            else:
                self.point = self.at + self.scale * self.way
            return
        else:
            s, y = self.point - self.at, gradient - self.gradient
            if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
                self.pairs = [*self.pairs, (s, y)][-self.memory :]
            self.taken += 1
        self.at, self.loss, self.gradient = self.point, loss, gradient
        if np.abs(gradient).max() <= self.tolerance or self.taken >= self.steps:
            self.done = True
            return
        self.way = -self._solved(gradient)
        self.slope = float(gradient @ self.way)
        if self.slope >= 0:
            self.pairs, self.way = [], -gradient
            self.slope = -float(gradient @ gradient)
        self.scale = self._first_scale()
        self.point = self.at + self.scale * self.way

    def _first_scale(self) -> float:
        return 1.0 if self.pairs else min(1.0, 1.0 / np.abs(self.gradient).sum())

    def _solved(self, gradient: np.ndarray) -> np.ndarray:
        q, kept = gradient.copy(), []
        for s, y in reversed(self.pairs):
            rho = 1 / (s @ y)
            a = rho * (s @ q)
            q -= a * y
            kept.append((rho, a, s, y))
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for rho, a, s, y in reversed(kept):
            q += (a - rho * (y @ q)) * s
        return q


class Newton(Lbfgs):
    """The same with the exact Hessian in place of remembered steps. Along intercepts that may shift together it takes the shortest step."""

    hessian = True

    def tell(self, loss: float, gradient: np.ndarray, hessian: np.ndarray | None = None) -> None:
        self.matrix = hessian
        super().tell(loss, gradient)

    def _first_scale(self) -> float:
        return 1.0

    def _solved(self, gradient: np.ndarray) -> np.ndarray:
        self.pairs = []
        return np.linalg.lstsq(self.matrix, gradient, rcond=1e-12)[0]


SOLVERS = {"lbfgs": Lbfgs, "newton": Newton}


@dataclass
class Blocks:
    """Packed rows: a DataFrame of n, x, y and flags, with what stands where. ``close`` gives their memory back."""

    rows: DataFrame
    widths: dict[str, int]
    flags: list[str]
    classes: list
    parts: int = field(init=False)

    def __post_init__(self) -> None:
        self.rows = self.rows.persist(StorageLevel.MEMORY_AND_DISK)
        self.parts = self.rows.rdd.getNumPartitions()

    def close(self) -> None:
        self.rows.unpersist()


def packed(rows: DataFrame, vecs: Sequence[str], label: str, flags: Sequence[str]) -> Blocks:
    """rows: ``vecs`` (arrays of one length each), ``label`` and boolean ``flags``, null for false. Rows without a label or a vector are left out.

    Labels are numbered in their order on the driver: a model has a column for each, so they are few.
    """
    rows = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (label, *vecs)))
    classes = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]
    first = rows.select(*[F.size(v).alias(v) for v in vecs]).first()
    widths = {v: first[v] if first else 0 for v in vecs}
    index = {c: i for i, c in enumerate(classes)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                x = np.hstack([b.column(v).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for v in vecs]) if b.num_rows else np.zeros((0, 1))
                f = np.stack([b.column(c).fill_null(False).to_numpy(zero_copy_only=False) for c in flags], 1).astype(np.uint8)
                y = np.array([index[c] for c in b.column(label).to_pylist()], np.int32)
                yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int32()), "x": pa.array([x.astype(np.float64).tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary()), "flags": pa.array([f.tobytes()], pa.binary())})

    picked = rows.select(*[F.col(v).cast("array<double>").alias(v) for v in vecs], label, *flags)
    return Blocks(picked.mapInArrow(pack, "n int, x binary, y binary, flags binary"), widths, list(flags), classes)


def _views(batches: Iterator[pa.RecordBatch], widths: dict[str, int], flags: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray]]]:
    edges = np.cumsum([0, *widths.values()])
    for batch in batches:
        for n, x, y, f in zip(*[batch.column(c).to_pylist() for c in ("n", "x", "y", "flags")], strict=True):
            x, f = np.frombuffer(x).reshape(n, -1), np.frombuffer(f, np.uint8).reshape(n, -1).astype(bool)
            yield {v: x[:, a:b] for v, a, b in zip(widths, edges, edges[1:], strict=False)}, np.frombuffer(y, np.int32), {c: f[:, i] for i, c in enumerate(flags)}


def _added(blocks: Blocks, part: object) -> dict[str, np.ndarray]:
    """The sums of what ``part`` (views -> name -> array) gives in each task: added up in groups of ``FAN`` tasks until one is left."""
    widths, flags = blocks.widths, blocks.flags

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = part(_views(batches, widths, flags))
        k = TaskContext.get().partitionId()
        if found:
            yield pa.RecordBatch.from_pydict({"name": list(found), "part": pa.array([k] * len(found), pa.int32()), "sums": pa.array([v.tobytes() for v in found.values()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in table.column("sums").to_pylist())
        return pa.table({"name": table.column("name")[:1], "part": pa.array([table.column("part")[0].as_py() // FAN], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    sums, left = blocks.rows.mapInArrow(each, "name string, part int, sums binary"), blocks.parts
    while True:
        sums = sums.groupBy("name", F.floor(F.col("part") / FAN).alias("to")).applyInArrow(add, "name string, part int, sums binary")
        left = -(-left // FAN)
        if left <= 1:
            return {r.name: np.frombuffer(r.sums).copy() for r in sums.select("name", "sums").collect()}


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = z.max(1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def _moments(blocks: Blocks, models: Sequence[Model]) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    kinds = sorted({(m.vec, m.train) for m in models})

    def sums(mean: dict[str, np.ndarray] | None) -> object:
        def part(views: Iterator) -> dict[str, np.ndarray]:
            out: dict[str, np.ndarray] = {}
            for x, _, f in views:
                for v, c in kinds:
                    rows = x[v][f[c]]
                    got = np.concatenate([[len(rows)], rows.sum(0) if mean is None else ((rows - mean[f"{v} {c}"]) ** 2).sum(0)])
                    out[f"{v} {c}"] = out.get(f"{v} {c}", 0) + got
            return out

        return part

    one = _added(blocks, sums(None))
    mean = {k: s[1:] / max(s[0], 1) for k, s in one.items()}
    two = _added(blocks, sums(mean))
    found = {k: (int(one[k][0]), mean[k], np.sqrt(two[k][1:] / max(one[k][0], 1)) + 1e-9) for k in one}
    return {m.name: found[f"{m.vec} {m.train}"] for m in models}


def fit(blocks: Blocks, models: Sequence[Model], solver: str = "lbfgs", l2: float = 1.0, tolerance: float = 1e-7) -> dict[str, Fitted]:
    """Each model by name. A model without training rows keeps weights of 0; a label that none of its training rows has gets what the intercept leaves it."""
    k, spark = len(blocks.classes), blocks.rows.sparkSession
    if not k:
        return {}
    sizes = {m.name: (blocks.widths[m.vec] + 1, k) for m in models}
    if sum(a * b for a, b in sizes.values()) > STATE or solver == "newton" and max(a * b for a, b in sizes.values()) > HESSIAN:
        raise ValueError("more parameters than the driver holds; fit fewer models at once")
    moments = _moments(blocks, models)
    states = {m.name: SOLVERS[solver](np.zeros(sizes[m.name][0] * k), m.steps, tolerance) for m in models}
    hessian = SOLVERS[solver].hessian
    for name, state in states.items():
        state.done = moments[name][0] == 0
    while live := [m for m in models if not states[m.name].done]:
        sent = spark.sparkContext.broadcast([(m, states[m.name].point.reshape(sizes[m.name]), *moments[m.name][1:]) for m in live])

        def part(views: Iterator, sent: object = sent) -> dict[str, np.ndarray]:
            out: dict[str, np.ndarray] = {}
            for x, y, f in views:
                for m, w, mean, deviation in sent.value:
                    pick = f[m.train]
                    rows, want = (x[m.vec][pick] - mean) / deviation, y[pick]
                    rows = np.hstack([rows, np.ones((len(rows), 1))])
                    z = rows @ w
                    p, total = _softmax(z)
                    loss = (total - z[np.arange(len(want)), want]).sum()
                    off = p.copy()
                    off[np.arange(len(want)), want] -= 1
                    got = [[loss], (rows.T @ off).ravel()]
                    if hessian:
                        d = rows.shape[1]
                        h = np.zeros((d, k, d, k))
                        for a in range(k):
                            for b in range(a, k):
                                cell = rows.T @ (rows * (p[:, a] * ((a == b) - p[:, b]))[:, None])
                                h[:, a, :, b] = cell
                                h[:, b, :, a] = cell.T
                        got.append(h.ravel())
                    out[m.name] = out.get(m.name, 0) + np.concatenate(got)
            return out

        sums = _added(blocks, part)
        sent.unpersist()
        for m in live:
            n, size = moments[m.name][0], sizes[m.name][0] * k
            w = states[m.name].point.reshape(sizes[m.name])
            free = np.vstack([np.ones((len(w) - 1, k)), np.zeros((1, k))]).ravel()  # intercepts aren't shrunk
            got, own = sums[m.name], w.ravel() * free
            matrix = got[1 + size :].reshape(size, size) / n + np.diag(l2 / n * free) if hessian else None
            states[m.name].tell(got[0] / n + l2 / (2 * n) * float(own @ own), got[1 : 1 + size] / n + l2 / n * own, matrix)
    out = {}
    for m in models:
        n, mean, deviation = moments[m.name]
        state = states[m.name]
        out[m.name] = Fitted(np.zeros(sizes[m.name]), mean, deviation, n)
        if n:
            out[m.name] = Fitted(state.at.reshape(sizes[m.name]), mean, deviation, n, state.taken, state.asked, state.taken >= m.steps, float(state.first), float(state.loss), float(np.abs(state.gradient).max()))
    return out


SCORES = "model string, n_train long, n_test long, accuracy double, train_loss double, test_loss double, iterations int, passes int, capped boolean, loss_before double, loss_after double, gradient double"


def scores(blocks: Blocks, models: Sequence[Model], fitted: dict[str, Fitted]) -> DataFrame:
    """One row for each model: accuracy and mean log loss of its test rows (null without any), the log loss of its training rows without the penalty, and how its fit went (PRB05)."""

    def part(views: Iterator) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for x, y, f in views:
            for m in models:
                got = []
                for pick in (f[m.train], f[m.test]):
                    p = _proba(fitted[m.name], x[m.vec][pick])
                    got += [pick.sum(), (p.argmax(1) == y[pick]).sum() if len(p) else 0, -np.log(np.maximum(p[np.arange(len(p)), y[pick]], 1e-300)).sum()]
                out[m.name] = out.get(m.name, 0) + np.array(got, float)
        return out

    sums = _added(blocks, part) if fitted else {}
    rows = []
    for m in models if fitted else []:
        n, _, loss, k, right, off = sums.get(m.name, np.zeros(6)).tolist()
        fit_ = fitted[m.name]
        rows.append((m.name, int(n), int(k), right / k if k else None, loss / n if n else None, off / k if k else None, fit_.iterations, fit_.passes, fit_.capped, fit_.loss_before, fit_.loss_after, fit_.gradient))
    return blocks.rows.sparkSession.createDataFrame(rows, SCORES)


def _proba(model: Fitted, x: np.ndarray) -> np.ndarray:
    return _softmax(np.hstack([(x - model.mean) / model.deviation, np.ones((len(x), 1))]) @ model.weights)[0]


def agreement(blocks: Blocks, models: Sequence[Model], first: dict[str, Fitted], second: dict[str, Fitted]) -> DataFrame:
    """For each model fitted twice, over its test rows: the share of equal predictions, and the largest and mean gap of probabilities (PRB07)."""
    k = len(blocks.classes)

    def part(views: Iterator) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for x, _, f in views:
            for m in models:
                rows = x[m.vec][f[m.test]]
                if len(rows):
                    a, b = _proba(first[m.name], rows), _proba(second[m.name], rows)
                    gap = np.abs(a - b)
                    out[m.name] = out.get(m.name, 0) + np.array([len(rows), (a.argmax(1) == b.argmax(1)).sum(), gap.sum(), 0.0])
                    # the largest gap doesn't add up: tasks leave theirs in a place of their own
                    out[f"max {m.name}"] = np.maximum(out.get(f"max {m.name}", 0), gap.max(keepdims=True).ravel()[:1])
        return {n: v for n, v in out.items() if not n.startswith("max ")} | {f"{n} {TaskContext.get().partitionId()}": v for n, v in out.items() if n.startswith("max ")}

    sums = _added(blocks, part)
    rows = []
    for m in models:
        n, same, gap, _ = sums.get(m.name, np.zeros(4)).tolist()
        top = max((float(v[0]) for c, v in sums.items() if c.startswith(f"max {m.name} ")), default=None)
        rows.append((m.name, int(n), same / n if n else None, top, gap / (n * k) if n else None))
    return blocks.rows.sparkSession.createDataFrame(rows, "model string, n_test long, same double, max_gap double, mean_gap double")
