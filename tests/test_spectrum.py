"""All lags of an autocorrelation, and their first peak, against plain loops."""

import numpy as np
import pandas as pd
import pytest

from tests.test_operators import frame
from tidemark.operators import series, spectrum


def plain(y):
    return np.array([(y[: len(y) - k] * y[k:]).sum() for k in range(len(y))])


def blocks_of(spark, values, size):
    rows = [(b, [float(v) for v in values[k: k + size]]) for b, k in enumerate(range(0, len(values), size))]
    return spark.createDataFrame(rows, "block long, values array<double>")


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000])
def test_all_lags(spark, monkeypatch, n):
    monkeypatch.setattr(spectrum, "LEAST_BLOCK", 16)  # many blocks on both levels
    monkeypatch.setattr(spectrum, "STEP_CELLS", 256)
    y = np.random.default_rng(n).normal(3, 2, n)
    got = spectrum.all_lags(frame(spark, row_id=np.arange(n), y=y), n).toPandas().sort_values("lag")
    assert list(got["lag"]) == list(range(n))
    assert np.allclose(got["value"], plain(y))


def test_nulls_and_whole_numbers(spark, monkeypatch):
    monkeypatch.setattr(spectrum, "LEAST_BLOCK", 16)
    y = np.random.default_rng(1).integers(-5, 6, 300).astype(float)
    got = spectrum.all_lags(frame(spark, row_id=np.arange(300), y=y), 300, whole=True).toPandas().sort_values("lag")
    assert list(got["value"]) == list(plain(y))  # equal, not close
    holes = [(i, None if i % 3 == 0 else float("nan") if i % 7 == 0 else v) for i, v in enumerate(y.tolist())]
    got = spectrum.all_lags(spark.createDataFrame(holes, "row_id long, y double"), 300).toPandas().sort_values("lag")
    assert np.allclose(got["value"], plain(np.where((np.arange(300) % 3 == 0) | (np.arange(300) % 7 == 0), 0, y)))
    assert spectrum.all_lags(spark.createDataFrame([], "row_id long, y double"), 0).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_peaks_across_blocks(spark, size):
    rng = np.random.default_rng(size)
    for k in range(12):
        values = rng.integers(0, 3, 40).cumsum() % 5 if k % 2 else np.repeat(rng.integers(0, 4, 14), 3)[:40]
        height = float(rng.integers(0, 4))
        peak = series.first_peak(values[1:].astype(float), height)
        want = None if peak is None else peak + 1
        assert spectrum.first_peak_of(blocks_of(spark, values, size), size, height) == want, (k, values)


def test_period_behind_the_first_lags(spark, monkeypatch):
    monkeypatch.setattr(series, "FIRST_LAGS", 8)
    monkeypatch.setattr(spectrum, "LEAST_BLOCK", 16)
    wave = np.sin(2 * np.pi * np.arange(777) / 90)
    want = series.first_peak(plain(wave)[1:], 0.1 * (wave ** 2).sum()) + 1
    assert want > 80
    assert series.detect_period(frame(spark, row_id=np.arange(777), y=wave), 777) == want
    rising = np.arange(1.0, 701.0)  # whole numbers, no peak
    assert series.detect_period(frame(spark, row_id=np.arange(700), y=rising), 700) == 70
