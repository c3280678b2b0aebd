"""Probes and clusterings fitted side by side, and label structure, against plain loops on small tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyspark.operators import agreement, minibatch, probes, structure, sweeps


def table(spark, n=120, labels=3, apart=3.0, seed=0, extra=()):
    rng = np.random.default_rng(seed)
    rows = [(i, int(y := rng.integers(labels)), [float(v) for v in rng.normal(size=5) + apart * np.eye(5)[y]], [float(v) for v in rng.normal(size=3)], bool(rng.random() < 0.7), bool(rng.random() < 0.5)) for i in range(n)]
    return spark.createDataFrame(rows + list(extra), "id long, label int, a array<double>, b array<float>, one boolean, two boolean")


def flagged(rows):
    return rows.withColumn("not_one", ~F.col("one")).withColumn("not_two", ~F.col("two"))


FLAGS = ["one", "two", "not_one", "not_two"]
MODELS = [sweeps.Model("a1", "a", "one", "not_one"), sweeps.Model("a2", "a", "two", "not_two"), sweeps.Model("b1", "b", "one", "not_one"), sweeps.Model("b1 capped", "b", "one", "not_one", 2)]


def plain(x, y, k, l2=1.0):
    """Newton's method on the full problem, row by row: the least loss and the weights."""
    x = np.hstack([(x - x.mean(0)) / (x.std(0) + 1e-9), np.ones((len(x), 1))])
    n, d = x.shape
    w, free = np.zeros((d, k)), np.append(np.ones(d - 1), 0)
    for _ in range(50):
        z = np.exp(x @ w - (x @ w).max(1, keepdims=True))
        p = z / z.sum(1, keepdims=True)
        g = x.T @ (p - np.eye(k)[y]) / n + l2 / n * w * free[:, None]
        h = sum(np.kron(np.outer(r, r), np.diag(q) - np.outer(q, q)) for r, q in zip(x, p, strict=True)) / n + l2 / n * np.diag(np.repeat(free, k))
        w = w - np.linalg.lstsq(h, g.ravel(), rcond=1e-12)[0].reshape(d, k)
    loss = -np.log(p[np.arange(n), y]).mean()
    return loss + l2 / (2 * n) * ((w * free[:, None]) ** 2).sum(), loss


@pytest.mark.parametrize("solver", ["lbfgs", "newton"])
def test_models_of_one_sweep_are_those_fitted_alone(spark, solver):
    rows = flagged(table(spark, apart=1.0)).repartition(5)
    blocks = sweeps.packed(rows, ["a", "b"], "label", FLAGS)
    together = sweeps.fit(blocks, MODELS, solver, tolerance=1e-9)
    data = {r.id: r for r in rows.collect()}
    for m in MODELS[:3]:
        train = [r for _, r in sorted(data.items()) if r[m.train]]
        whole, loss = plain(np.array([r[m.vec] for r in train], float), np.array([r.label for r in train]), 3)
        assert together[m.name].loss_after == pytest.approx(whole, abs=1e-8) and together[m.name].gradient < 1e-8
        alone = sweeps.fit(blocks, [m], solver, tolerance=1e-9)[m.name]
        assert np.abs(alone.weights - together[m.name].weights).max() < 1e-12
    got = {r.model: r for r in sweeps.scores(blocks, MODELS, together).collect()}
    assert got["a1"].train_loss == pytest.approx(plain(np.array([r.a for _, r in sorted(data.items()) if r.one]), np.array([r.label for _, r in sorted(data.items()) if r.one]), 3)[1], abs=1e-7)
    assert got["a1"].n_train + got["a1"].n_test == 120 and got["b1 capped"].capped == (solver == "lbfgs" or got["b1 capped"].iterations >= 2)
    blocks.close()


def test_sweep_doesnt_depend_on_partitions_or_the_tree(spark, monkeypatch):
    rows = flagged(table(spark))
    want = None
    for parts, fan in ((1, 32), (7, 32), (9, 2)):
        monkeypatch.setattr(sweeps, "FAN", fan)
        blocks = sweeps.packed(rows.repartition(parts), ["a", "b"], "label", FLAGS)
        got = sorted((r.model, r.n_train, r.n_test, r.accuracy, round(r.loss_after, 9)) for r in sweeps.scores(blocks, MODELS, sweeps.fit(blocks, MODELS)).collect())
        want = want or got
        assert got == want
        blocks.close()


def test_solvers_agree_and_gaps_are_found(spark):
    rows = flagged(table(spark, apart=1.5)).repartition(4)
    blocks = sweeps.packed(rows, ["a", "b"], "label", FLAGS)
    one, two = sweeps.fit(blocks, MODELS[:3], tolerance=1e-9), sweeps.fit(blocks, MODELS[:3], "newton", tolerance=1e-9)
    assert all(abs(one[m].loss_after - two[m].loss_after) < 1e-8 for m in one)
    assert all(r.same == 1.0 and r.max_gap < 1e-5 and r.mean_gap <= r.max_gap for r in sweeps.agreement(blocks, MODELS[:3], one, two).collect())
    early = sweeps.fit(blocks, [sweeps.Model("a1", "a", "one", "not_one", 1)])
    r = sweeps.agreement(blocks, MODELS[:1], one, early).collect()[0]
    test = [x.a for x in rows.where("not_one").collect()]
    gap = np.abs(sweeps._proba(one["a1"], np.array(test)) - sweeps._proba(early["a1"], np.array(test)))
    assert r.n_test == len(test) and r.max_gap == pytest.approx(gap.max()) and r.mean_gap == pytest.approx(gap.mean())
    blocks.close()


def test_sweep_of_odd_tables(spark):
    odd = [(900, None, [0.0] * 5, [0.0] * 3, True, True), (901, 1, None, [0.0] * 3, True, True), (902, 7, [50.0] * 5, [0.0] * 3, None, False)]
    rows = flagged(table(spark, 40, apart=9.0, extra=odd)).withColumn("none", F.lit(False))
    blocks = sweeps.packed(rows, ["a", "b"], "label", [*FLAGS, "none"])
    assert blocks.classes == [0, 1, 2, 7]
    models = [sweeps.Model("a", "a", "one", "not_one"), sweeps.Model("nothing", "a", "none", "one")]
    got = {r.model: r for r in sweeps.scores(blocks, models, sweeps.fit(blocks, models)).collect()}
    assert got["a"].accuracy == 1.0 and got["a"].n_train + got["a"].n_test == 40
    assert got["nothing"].n_train == 0 and got["nothing"].train_loss is None and got["nothing"].test_loss == pytest.approx(math.log(4))
    blocks.close()
    empty = sweeps.packed(rows.where("1 = 0"), ["a"], "label", ["one", "not_one"])
    assert sweeps.scores(empty, models[:1], sweeps.fit(empty, models[:1])).count() == 0
    empty.close()
    with pytest.raises(ValueError):
        big = sweeps.packed(rows, ["a"], "label", ["one", "not_one"])
        sweeps.HESSIAN, kept = 3, sweeps.HESSIAN
        try:
            sweeps.fit(big, models[:1], "newton")
        finally:
            sweeps.HESSIAN = kept


def test_splits_are_halves(spark):
    rows = table(spark, 60, labels=4)
    both = probes.splits(rows, "label", "id", (0, 3))
    for s in (0, 3):
        want = {r.id: r.test for r in probes.halves(rows, "label", "id", s).collect()}
        assert {r.id: r[f"test_{s}"] for r in both.collect() if r[f"test_{s}"] or r[f"train_{s}"]} == want


# ---- clusterings


def test_steps_replayed_row_by_row():
    rng = np.random.default_rng(2)
    x, h = rng.normal(size=(90, 2)), rng.integers(-(2**62), 2**62, 90)
    got = minibatch.steps_of(x, h, 4, 5, 1, 7, 3)
    start = np.random.default_rng([5, 1])
    first = [i for i in range(90) if minibatch.slots(h[i : i + 1], 0, 3)[0] < 1]
    centres = minibatch.first_centres(x[first], 4, start)
    seen = [0] * 4
    for step in range(7):
        batch = [x[i] for i in range(90) if minibatch.slots(h[i : i + 1], step // 3, 3)[0] == step % 3]
        near = [min(range(4), key=lambda c: ((r - centres[c]) ** 2).sum()) for r in batch]
        for c in range(4):
            mine = [r for r, n in zip(batch, near, strict=True) if n == c]
            seen[c] += len(mine)
            if mine:
                centres[c] = centres[c] + (sum(mine) - len(mine) * centres[c]) / seen[c]
        assert all(seen)
    assert np.abs(got - centres).max() < 1e-9


@pytest.mark.parametrize("batch", [1024, 16, 1])
def test_clusters_of_apart_labels(spark, batch):
    rows = table(spark, 200, apart=12.0)
    runs = minibatch.fit(rows, ["a", "b"], 3, (0, 4), starts=4, steps=60, batch=batch)
    again = minibatch.fit(rows.repartition(9), ["a", "b"], 3, (0, 4), starts=4, steps=60, batch=batch)
    assert [(r.vec, r.seed, r.start) for r in runs] == [(r.vec, r.seed, r.start) for r in again] and all((p.centres == q.centres).all() for p, q in zip(runs, again, strict=True))
    found = minibatch.labelled(rows, runs, "id", "label")
    got = {(r.vec, r.seed): r for r in agreement.by_group(found, ["vec", "seed"], "label", "cluster").collect()}
    assert len(got) == 4 and all(got["a", s].ari == pytest.approx(1) and got["a", s].ami == pytest.approx(1) for s in (0, 4))
    for r in runs:
        x = np.array([y[0] for y in rows.select(F.col(r.vec).cast("array<double>")).collect()])
        assert r.cost == pytest.approx(minibatch.distances(x, r.centres).min(1).sum(), abs=1e-6)


def test_labels_are_counted_in_place_of_rows(spark):
    rows = table(spark, 200, apart=1.0, extra=[(900, None, [0.0] * 5, [1.0] * 3, True, True)])
    runs = minibatch.fit(rows, ["a", "b"], 3, (0, 4), steps=9, batch=16)
    found = minibatch.labelled(rows, runs, "label")
    want = {tuple(r) for r in found.groupBy("vec", "seed", "label", "cluster").count().collect()}
    counts = minibatch.counted(rows.coalesce(2), runs, "label")
    assert {tuple(r) for r in counts.groupBy("vec", "seed", "label", "cluster").agg(F.sum("n")).collect()} == want
    assert counts.count() <= 2 * len(want) < found.count()
    by = lambda x, *w: sorted(tuple(r) for r in agreement.by_group(x, ["vec", "seed"], "label", "cluster", *w).collect())
    for one, two in zip(by(found.dropna()), by(counts.dropna(), "n"), strict=True):
        assert one[:3] == two[:3] and one[3:] == pytest.approx(two[3:])


def test_expected_overlaps_are_shared_out_before_they_are_spread(spark):
    plan = agreement.by_group(spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "g int, u int, v int"), ["g"], "u", "v")._jdf.queryExecution().optimizedPlan().toString()
    spread = plan.split("Generate explode")[1]
    assert "RepartitionByExpression" in spread and str(agreement.log_factorial(F.col("k"))).count("ln(") + str(agreement.log_factorial(F.col("k"))).upper().count("LOG(") <= 4


def test_clusterings_of_odd_tables(spark):
    rows = table(spark, 3, extra=[(9, 1, None, None, True, True)])
    runs = minibatch.fit(rows, ["a"], 5, (0,))
    assert runs[0].centres.shape == (5, 5) and minibatch.labelled(rows, runs, "id").count() == 3
    assert minibatch.fit(rows.where("1 = 0"), ["a"], 5, (0,)) == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "id long, v array<double>")
    assert minibatch.fit(same, ["v"], 3, (0,))[0].cost == 0.0


def expected_mi(a, b):
    t = sum(a)
    total = 0.0
    for x in a:
        for y in b:
            for k in range(max(1, x + y - t), min(x, y) + 1):
                total += k / t * math.log(t * k / (x * y)) * math.comb(y, k) * math.comb(t - y, x - k) / math.comb(t, x)
    return total


def test_agreement_by_group(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(u := rng.integers(4)), int(u if rng.random() < 0.6 else rng.integers(3))) for g in ("p", "q") for _ in range(70)] + [("one", 0, 0), ("same", 1, 2), ("same", 1, 2), *[("apart", i, i) for i in range(5)]]
    frame = spark.createDataFrame(rows, "g string, u int, v int")
    got = {r.g: r for r in agreement.by_group(frame, ["g"], "u", "v").collect()}
    for g in ("p", "q"):
        part = frame.where(F.col("g") == g)
        s, ami = agreement.scores(part, "u", "v").collect()[0], agreement.adjusted_mi(part, "u", "v").collect()[0].ami
        a = [len([1 for r in rows if r[0] == g and r[1] == x]) for x in {r[1] for r in rows if r[0] == g}]
        b = [len([1 for r in rows if r[0] == g and r[2] == x]) for x in {r[2] for r in rows if r[0] == g}]
        h = [-sum(n / 70 * math.log(n / 70) for n in m) for m in (a, b)]
        assert got[g].ami == pytest.approx((s.mi - expected_mi(a, b)) / (sum(h) / 2 - expected_mi(a, b))) and got[g].ami == pytest.approx(ami)
        assert (got[g].ari, got[g].v_measure, got[g].purity) == pytest.approx((s.ari, s.v_measure, s.purity)) and got[g].nmi == pytest.approx(s.mi / (sum(h) / 2))
    assert all(got[g].ari == got[g].ami == got[g].nmi == 1.0 for g in ("one", "same")) and got["apart"].ari == 1.0


def test_overlaps_left_out_have_no_weight(spark):
    """Margins of thousands: what the cut sum leaves out of the expected mutual information is nothing."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([("g", int(rng.integers(2)), int(rng.integers(3))) for _ in range(6000)], "g string, u int, v int")
    assert agreement.by_group(rows, ["g"], "u", "v").collect()[0].ami == pytest.approx(agreement.adjusted_mi(rows, "u", "v").collect()[0].ami, abs=1e-9)


def test_structure_against_plain_loops(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.integers(0, 4, 40)
    y[0] = 9  # a label of one row
    rows = structure.long(spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(y, x, strict=True))], "id long, label int, one array<double>").withColumn("two", F.col("one")), ["one", "two"], "id", "label").repartition(6)
    sil = []
    for i in range(40):
        d = {c: np.mean([1 - x[i] @ x[j] for j in range(40) if y[j] == c and j != i]) for c in set(y) if any(y[j] == c and j != i for j in range(40))}
        a, b = d.get(y[i]), min(v for c, v in d.items() if c != y[i])
        sil.append(0 if a is None else (b - a) / max(a, b))
    centres = {c: x[y == c].mean(0) for c in set(y)}
    s = {c: np.mean(np.linalg.norm(x[y == c] - centres[c], axis=1)) for c in centres}
    dbi = np.mean([max((s[i] + s[j]) / np.linalg.norm(centres[i] - centres[j]) for j in centres if j != i) for i in centres])
    between = sum((y == c).sum() * ((centres[c] - x.mean(0)) ** 2).sum() for c in centres)
    chi = between / (len(centres) - 1) / (sum(((x[y == c] - centres[c]) ** 2).sum() for c in centres) / (40 - len(centres)))
    cov = np.cov(x.T)
    cos = np.mean([x[i] @ x[j] for i, j in itertools.combinations(range(40), 2)])
    for r in structure.spreads(rows).join(structure.silhouettes(rows), "layer").join(structure.shapes(rows), "layer").collect():
        assert (r.silhouette, r.davies_bouldin, r.calinski_harabasz, r.mean_cos, r.eff_rank) == pytest.approx((np.mean(sil), dbi, chi, cos, np.trace(cov) ** 2 / (cov**2).sum()))
    single = rows.where("layer = 'one'").withColumn("label", F.lit(1))
    assert structure.silhouettes(single).collect()[0].silhouette == 0 and structure.spreads(single).collect()[0].calinski_harabasz is None
