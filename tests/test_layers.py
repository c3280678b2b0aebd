"""Layer scores, the directions in use, cepstral features and the encoder seam on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyspark.functions import sound
from tallyspark.operators import layers


def frame(spark, vectors, labels):
    return spark.createDataFrame([(i, int(y), [float(x) for x in v]) for i, (v, y) in enumerate(zip(vectors, labels, strict=True))], "id long, label int, e array<double>")


def test_layers_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 6)), rng.integers(0, 3, 40)
    x[:, :3] += 4 * np.eye(3)[y]
    rows = layers.layered(frame(spark, x, y), "e", 2, 3)
    got = {r.layer: r for r in layers.nearest_label(rows, (-1, 0, 1)).collect()}
    cosines = {r.layer: r for r in layers.mean_cosines(rows, (-1, 0, 1)).collect()}
    for k, part in ((0, x[:, :3]), (1, x[:, 3:]), (-1, (x[:, :3] + x[:, 3:]) / 2)):
        u = part / np.linalg.norm(part, axis=1, keepdims=True)
        sims, same, off = u @ u.T, y[:, None] == y, ~np.eye(40, dtype=bool)
        near = np.where(off, sims, -2).argmax(axis=1)
        assert got[k].top1 == pytest.approx(np.mean(y[near] == y), abs=1e-6) and got[k].n == 40
        assert cosines[k].same_cos == pytest.approx(sims[same & off].mean())
        assert cosines[k].other_cos == pytest.approx(sims[~same].mean())


def test_ties_and_single_labels(spark):
    rows = layers.layered(frame(spark, [[1, 0], [1, 0], [1, 0]], [1, 2, 2]), "e", 1, 2)
    assert layers.nearest_label(rows, (0,)).collect()[0].top1 == pytest.approx(0, abs=1e-6)  # row 0 meets 1, rows 1 and 2 meet 0
    alone = layers.mean_cosines(layers.layered(frame(spark, [[1, 0]], [1]), "e", 1, 2), (0,)).collect()[0]
    assert alone.same_cos is None and alone.other_cos is None


def test_transfer_takes_the_lowest_of_equals(spark):
    dev = spark.createDataFrame([(-1, 0.9, 5), (0, 0.5, 5), (1, 0.5, 5), (2, 0.1, 5)], "layer int, top1 double, n long")
    test = spark.createDataFrame([(-1, 0.3, 6), (0, 0.4, 6), (1, 0.6, 6), (2, 0.2, 6)], "layer int, top1 double, n long")
    r = layers.transfer(dev, test, 2).collect()[0]
    assert (r.picked_layer, r.best_test_layer, r.n_dev, r.n_test) == (0, 1, 5, 6)
    assert (r.gain_vs_final, r.gain_vs_uniform, r.shortfall) == pytest.approx((0.2, 0.1, 0.2))


def test_participation(spark):
    x = np.random.default_rng(2).normal(size=(50, 4)) * [3, 1, 1, 0.1]
    values = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    r = layers.participation(frame(spark, x, [0] * 50).repartition(5), "e").collect()[0]
    assert (r.n_rows, r.dim) == (50, 4) and r.participation_ratio == pytest.approx(values.sum() ** 2 / (values**2).sum())
    assert layers.participation(frame(spark, [[1, 2]], [0]), "e").collect()[0].participation_ratio is None


def test_cepstral_features_window_by_window(spark):
    wave = np.sin(np.arange(3000) * 0.3) + 0.1 * np.random.default_rng(3).normal(size=3000)
    weights, rows = sound.mel_weights(16000, 40), []
    assert weights.shape == (40, 257) and weights.max() <= 1 and (weights >= 0).all()
    for at in range(0, len(wave) - 511, 160):
        spectrum = np.abs(np.fft.rfft(wave[at : at + 512] * np.hanning(512))) ** 2
        mel = [np.log(sum(w * p for w, p in zip(band, spectrum, strict=True)) + 1e-10) for band in weights]
        rows.append([sum(m * np.cos(np.pi / 40 * (b + 0.5) * k) for b, m in enumerate(mel)) for k in range(20)])
    want = np.concatenate([np.mean(rows, axis=0), np.std(rows, axis=0)])
    assert np.allclose(sound.cepstrum(wave, block=3), want)
    got = spark.createDataFrame([(1, wave.tolist()), (2, []), (3, None)], "id int, w array<double>").select("id", sound.cepstral(F.col("w")).alias("f")).orderBy("id").collect()
    assert np.allclose(got[0].f, want) and len(got[1].f) == 40 and np.allclose(got[1].f[20:], 0) and got[2].f is None


def test_encoder_seam(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id long, t string")
    start = lambda: lambda given: np.array([[len(x), 1] for x in given])
    assert {r.id: r.vec for r in sound.encoded(rows, "t", "id", start, batch=2).collect()} == {1: [2, 1], 2: None, 3: [0, 1]}
    with pytest.raises(Exception, match="encoder made shape"):
        sound.encoded(rows, "t", "id", lambda: lambda given: np.ones(2)).collect()
