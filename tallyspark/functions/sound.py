"""Cepstral features of waveforms and the seam for any other encoder (VEC11, API07)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Samples of a window and between windows, lowest frequency, floor under the logarithm, and the mel scale's constants.
WINDOW, STEP, LOWEST_HZ, FLOOR = 512, 160, 20.0, 1e-10
MEL_FACTOR, MEL_HZ = 2595.0, 700.0


def mel_weights(rate: int, bands: int) -> np.ndarray:
    """Triangles of ``bands`` mel bands over the bins of one window's spectrum."""
    mel = MEL_FACTOR * np.log10(1 + np.array([LOWEST_HZ, rate / 2]) / MEL_HZ)
    corners = MEL_HZ * (10 ** (np.linspace(*mel, bands + 2) / MEL_FACTOR) - 1)
    bins = np.linspace(0, rate / 2, WINDOW // 2 + 1)
    slopes = bins - corners[:, None]
    rise, fall = slopes[:-2] / np.diff(corners)[:-1, None], -slopes[2:] / np.diff(corners)[1:, None]
    return np.clip(np.minimum(rise, fall), 0, None)


def cepstrum(wave: np.ndarray, rate: int = 16000, kept: int = 20, bands: int = 40, block: int = 4096) -> np.ndarray:
    """Means and then deviations over all windows of ``kept`` cepstral coefficients.

    Short waves are filled with zeros to two windows. Windows are taken ``block`` at a time, so that
    memory doesn't grow with the length of a recording.
    """
    x = np.asarray(wave, dtype=np.float64)
    x = np.pad(x, (0, max(0, 2 * WINDOW - len(x))))
    windows = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::STEP]
    weights = mel_weights(rate, bands).T
    cosines = np.cos(np.pi / bands * np.outer(np.arange(bands) + 0.5, np.arange(kept)))
    taper, found = np.hanning(WINDOW), []
    for at in range(0, len(windows), block):
        power = np.abs(np.fft.rfft(windows[at : at + block] * taper)) ** 2
        found.append(np.log(power @ weights + FLOOR) @ cosines)
    c = np.concatenate(found)
    return np.concatenate([c.mean(axis=0), c.std(axis=0)])


def cepstral(wave: Column, rate: int = 16000, kept: int = 20, bands: int = 40) -> Column:
    """array<double> of 2 * ``kept`` values; null for null, and an empty wave counts as silence."""

    @F.pandas_udf("array<double>")
    def features(waves: pd.Series) -> pd.Series:
        return waves.map(lambda w: None if w is None else cepstrum(w, rate, kept, bands))

    return features(wave.cast("array<double>"))


def encoded(rows: DataFrame, column: str, ident: str, start: Callable[[], Callable[[list], np.ndarray]], batch: int = 32) -> DataFrame:
    """``ident`` and vec: what an encoder makes of ``column``.

    ``start`` is called once for each task and returns a function from a list of at most ``batch``
    inputs to a matrix of one row each. Null inputs have a null vector and are not passed on; any
    other number of rows, or a result that is no matrix, is an error.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = start()
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                given = [x for x in some[column] if x is not None]
                made = np.asarray(encode(given), dtype=np.float64) if given else np.empty((0, 0))
                if made.ndim != 2 or len(made) != len(given):
                    raise ValueError(f"encoder made shape {made.shape} of {len(given)} inputs")
                rest = iter(made)
                yield pd.DataFrame({ident: some[ident].to_numpy(), "vec": [None if x is None else next(rest) for x in some[column]]})

    return rows.select(ident, column).mapInPandas(run, f"`{ident}` {rows.schema[ident].dataType.simpleString()}, vec array<double>")
