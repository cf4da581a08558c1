"""The interpolated score surface: planes, representatives, lines, odd rows."""

import numpy as np
import pandas as pd
import pytest

from tidemark.plans import report


def surface(spark, x, y, score, cells=50):
    points = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "score": score}))
    return report.score_surface(points, cells).toPandas().sort_values(["gx", "gy"], ignore_index=True)


def test_plane_at_every_node(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 4, 500), rng.exponential(3, 500)
    plane = lambda a, b: 0.5 + 0.01 * a - 0.004 * b
    got = surface(spark, x, y, plane(x, y))
    assert len(got) == 2500
    assert got["x"].min() == x.min() and np.isclose(got["y"].max(), y.max())
    assert np.allclose(got["score"], plane(got["x"], got["y"]))


def test_runs_through_single_points(spark):
    x, y = [0.0, 4.0, 0.0, 4.0, 2.0], [0.0, 0.0, 4.0, 4.0, 2.0]
    score = [0.0, 0.2, 0.4, 0.6, 1.0]
    got = surface(spark, x, y, score, 5).set_index(["gx", "gy"])["score"]
    assert np.allclose([got[int(a), int(b)] for a, b in zip(x, y)], score, atol=1e-4)
    assert got.between(0, 1).all()


def test_points_on_a_line_or_one_place(spark):
    got = surface(spark, [0.0, 1.0, 2.0], [3.0, 3.0, 3.0], [0.1, 0.5, 0.9], 3).set_index(["gx", "gy"])["score"]
    assert len(got) == 9 and np.isclose(got[1, 0], 0.5)
    assert got[0, 0] < got[1, 0] < got[2, 0]
    assert np.allclose(surface(spark, [7.0, 7.0], [1.0, 1.0], [0.2, 0.4], 3)["score"], 0.3)


def test_odd_rows(spark):
    rows = [(0.0, 0.0, 0.5), (1.0, 1.0, 0.5), (None, 1.0, 0.9), (float("nan"), 0.0, 0.9), (9.0, 9.0, None)]
    points = spark.createDataFrame(rows, "x double, y double, score double")
    got = report.score_surface(points, 2).toPandas()
    assert np.allclose(got["score"], 0.5) and got["x"].max() == 1.0
    assert report.score_surface(points.limit(0)).count() == 0
    with pytest.raises(ValueError):
        report.score_surface(points, 1000)
