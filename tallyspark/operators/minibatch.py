"""Mini-batch k-means of many layers and seeds side by side (CLU01, CLU12, QRY28, QRY32).

A step looks at one batch, so a run sees ``steps`` batches of about ``batch`` rows whatever the table's size. Which rows these are
is a matter of keyed hashes: each epoch deals the rows into batches anew, and the batches of as many epochs as the steps
need are taken, so the draw doesn't depend on partitions. One pass picks the rows of all runs; each layer and seed is then run
in one task, all of its starts on the same batches; a second pass sums every run's cost over all rows, of
which the cheapest start counts, and a third labels the rows. What the driver holds are centres.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of all centres together that are sent to all tasks.
CENTRES = 20_000_000
#: Rows whose labels are counted at a time.
PIECE = 16_384


@dataclass(frozen=True)
class Run:
    """The centres of a layer's run, its seed and the start it came from, and its cost over all rows."""

    vec: str
    seed: int
    start: int
    cost: float
    centres: np.ndarray


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    x = h.astype(np.uint64) + np.uint64((j * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def slots(h: np.ndarray, epoch: int, per_epoch: int) -> np.ndarray:
    """The batch of an epoch that each row is dealt to, from its keyed hash."""
    return (h % per_epoch if epoch == 0 else (_mixed(h, epoch) % np.uint64(per_epoch)).astype(np.int64)).astype(np.int64)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, none below 0."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def first_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Rows of ``x``, each drawn with a weight by its squared distance to those before it; of fewer than k different rows some repeat."""
    picks = [int(rng.integers(len(x)))]
    far = distances(x, x[picks])[:, 0]
    while len(picks) < k:
        total = far.sum()
        picks.append(int(np.searchsorted(np.cumsum(far), rng.random() * total, "right")) if total > 0 else int(rng.integers(len(x))))
        picks[-1] = min(picks[-1], len(x) - 1)
        far = np.minimum(far, distances(x, x[picks[-1:]])[:, 0])
    return x[picks].copy()


def steps_of(x: np.ndarray, h: np.ndarray, k: int, seed: int, start: int, steps: int, per_epoch: int) -> np.ndarray:
    """The centres after ``steps`` batches of rows ``x`` with keyed hashes ``h``, in the order of these."""
    rng = np.random.default_rng([seed, start])
    first = np.flatnonzero(slots(h, 0, per_epoch) < max(1, -(-3 * k * per_epoch // max(len(x), 1))))
    centres, seen = first_centres(x[first if len(first) else slice(None)], k, rng), np.zeros(k)
    for step in range(steps):
        epoch, slot = divmod(step, per_epoch)
        if slot == 0 and per_epoch > 1:  # an epoch's batches, one after another
            dealt = slots(h, epoch, per_epoch)
            order = np.argsort(dealt, kind="stable")
            edge = np.searchsorted(dealt[order], np.arange(min(per_epoch, steps) + 1))
        batch = x[order[edge[slot] : edge[slot + 1]]] if per_epoch > 1 else x
        if not len(batch):
            continue
        d = distances(batch, centres)
        own = d.argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, column, k) for column in batch.T], 1)
        seen += n
        at = n > 0
        centres[at] += (sums[at] - n[at, None] * centres[at]) / seen[at, None]
        lost = np.flatnonzero(seen == 0)  # a centre that nothing ever came to moves to the rows farthest off
        if len(lost):
            away = np.argsort(-d[np.arange(len(batch)), own], kind="stable")[: len(lost)]
            centres[lost[: len(away)]] = batch[away]
    return centres


def fit(rows: DataFrame, vecs: Sequence[str], k: int, seeds: Sequence[int], starts: int = 3, steps: int = 100, batch: int = 1024) -> list[Run]:
    """rows: id (whole number) and ``vecs``, arrays of one length each; null ones are left out. A run for each of ``vecs`` and seed.

    Fewer than k rows give centres that repeat; no rows, no runs. Equal costs go to the earlier start.
    """
    rows = rows.select(F.col("id").cast("long").alias("id"), *[F.col(v).cast("array<double>").alias(v) for v in vecs]).dropna()
    n = rows.count()
    if not n or not k:
        return []
    per_epoch = -(-n // batch)
    seeded = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.xxhash64(F.lit(s), "id").alias("h")) for s in seeds]))
    drawn = rows.withColumn("x", seeded).select("id", "x.seed", "x.h", *vecs)
    if per_epoch > steps:
        drawn = drawn.where(F.pmod("h", F.lit(per_epoch)) < steps)
    each = drawn.select("id", "seed", "h", F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).alias("vec")) for v in vecs])).alias("x")).select("id", "seed", "h", "x.name", "x.vec")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("id", "ascending")])
        x, h = _matrix(table.column("vec")), table.column("h").to_numpy()
        seed = table.column("seed")[0].as_py()
        found = [steps_of(x, h, k, seed, s, steps, per_epoch).tobytes() for s in range(starts)]
        return pa.table({"name": pa.array([table.column("name")[0].as_py()] * starts), "seed": pa.array([seed] * starts, pa.int32()), "start": pa.array(range(starts), pa.int32()), "centres": pa.array(found, pa.binary())})

    made = [(r.name, r.seed, r.start, np.frombuffer(r.centres).reshape(k, -1)) for r in each.groupBy("name", "seed").applyInArrow(run, "name string, seed int, start int, centres binary").collect()]
    if sum(c.size for *_, c in made) > CENTRES:
        raise ValueError("more centres than are sent to all tasks; fit fewer layers or seeds at once")
    sent = rows.sparkSession.sparkContext.broadcast(made)

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(made))
        of = {v: [i for i, m in enumerate(sent.value) if m[0] == v] for v in vecs}
        for b in batches:
            for v, mine in of.items() if b.num_rows else ():
                # all runs of a layer in one product
                d = distances(_matrix(b.column(v)), np.concatenate([sent.value[i][3] for i in mine]))
                total[mine] += d.reshape(len(d), len(mine), k).min(2).sum(0)
        yield pa.RecordBatch.from_pydict({"run": np.arange(len(total)), "cost": total})

    costs = {r.run: round(r.cost, 9) for r in rows.select(*vecs).mapInArrow(cost, "run long, cost double").groupBy("run").agg(F.sum("cost").alias("cost")).collect()}
    sent.unpersist()
    best: dict[tuple[str, int], Run] = {}
    for i, (name, seed, start, centres) in enumerate(made):
        now = best.get((name, seed))
        if now is None or (costs[i], start) < (now.cost, now.start):
            best[name, seed] = Run(name, seed, start, costs[i], centres)
    return sorted(best.values(), key=lambda r: (r.vec, r.seed))


def labelled(rows: DataFrame, runs: Sequence[Run], *carry: str) -> DataFrame:
    """``carry``, vec, seed and cluster of each row of ``rows`` and run: the nearest centre, the first of equals. Null vectors have none and no row."""
    vecs = list(dict.fromkeys(r.vec for r in runs))
    sent = rows.sparkSession.sparkContext.broadcast(list(runs))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in sent.value if b.num_rows else ():
                found = distances(_matrix(b.column(r.vec)), r.centres).argmin(1)
                yield pa.RecordBatch.from_pydict({c: b.column(c) for c in carry} | {"vec": pa.array([r.vec] * len(found)), "seed": pa.array([r.seed] * len(found), pa.int32()), "cluster": found.astype(np.int32)})

    picked = rows.select(*carry, *[F.col(v).cast("array<double>").alias(v) for v in vecs if v not in carry]).dropna(subset=vecs)
    return picked.mapInArrow(near, f"{fields}, vec string, seed int, cluster int")


def counted(rows: DataFrame, runs: Sequence[Run], label: str) -> DataFrame:
    """vec, seed, ``label``, cluster and n: how many rows of a label each cluster has, counted over ``PIECE`` rows at a time; ``n`` is to be summed.

    For ``agreement.by_group``, without a row for each row and run. Rows are those of ``labelled``.
    """
    vecs = list(dict.fromkeys(r.vec for r in runs))
    sent = rows.sparkSession.sparkContext.broadcast(list(runs))
    kind = rows.schema[label].dataType.simpleString()

    def count(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        codes = whole.column(label).combine_chunks().dictionary_encode(null_encoding="encode")
        if isinstance(codes, pa.ChunkedArray):
            codes = codes.combine_chunks()
        names, code = codes.dictionary, codes.indices.to_numpy().astype(np.int64)
        for v in vecs:
            x = _matrix(whole.column(v))
            for r in sent.value:
                if r.vec == v:
                    wide = len(r.centres)
                    cell, n = np.unique(code * wide + distances(x, r.centres).argmin(1), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"vec": pa.array([v] * len(cell)), "seed": pa.array([r.seed] * len(cell), pa.int32()), label: names.take(pa.array(cell // wide)), "cluster": (cell % wide).astype(np.int32), "n": n.astype(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(h.num_rows for h in held) >= PIECE:
                yield from count(held)
                held = []
        if held:
            yield from count(held)

    picked = rows.select(label, *[F.col(v).cast("array<double>").alias(v) for v in vecs]).dropna(subset=vecs)
    return picked.mapInArrow(run, f"vec string, seed int, `{label}` {kind}, cluster int, n long")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
