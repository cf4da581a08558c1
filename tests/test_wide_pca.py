"""Components without a covariance matrix, against those with one."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import linalg


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) @ (rng.normal(size=(6, 60)) * np.array([9, 7, 5, 4, 3, 2])[:, None])
    x = x + 0.05 * rng.normal(size=x.shape) + 100
    cols = [f"c{i}" for i in range(60)]
    return spark.createDataFrame(pd.DataFrame(x, columns=cols)).repartition(4).cache(), cols


@pytest.mark.parametrize("wanted", [3, 0.95, 0.999999])
def test_equals_the_covariance_path(spark, table, monkeypatch, wanted):
    df, cols = table
    monkeypatch.setattr(linalg, "FIRST_WIDTH", 2)  # has to grow
    monkeypatch.setattr(linalg, "SPARE", 3)
    want = linalg.fit_pca(df, cols, wanted)
    monkeypatch.setattr(linalg, "GRAM_COLUMNS", 20)
    got = linalg.fit_pca(df, cols, wanted)
    assert got.k == want.k
    assert np.allclose(got.mean, want.mean) and np.isclose(got.total, want.variances.sum())
    assert np.abs(got.variances[: got.k] - want.variances[: got.k]).max() <= got.residual + 1e-9 * got.total
    if wanted != 0.999999:  # there the last ones are noise of nearly equal variance
        assert got.residual <= 1e-6 * got.variances[0]
        assert np.allclose(got.components, want.components, atol=1e-4)
        a, b = (np.sort(p.with_residual(df).toPandas()["raw"].to_numpy()) for p in (got, want))
        assert np.allclose(a, b, atol=1e-3)
    assert np.isclose(got.explained, want.explained, atol=1e-6)


def test_constant_and_empty(spark, table):
    _, cols = table
    still = spark.createDataFrame(pd.DataFrame(np.ones((5, 60)), columns=cols))
    for df in (still, still.limit(0)):
        found = linalg.fit_wide_pca(df, cols, 0.95)
        assert found.total == 0 and found.residual == 0
