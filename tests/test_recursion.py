"""Exact recursions, the certificate of the one-class SVM, and metrics of many segments at once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_detectors import make_frame
from tidemark.detectors import registry
from tidemark.detectors.statistical import nearest_to_origin
from tidemark.operators import recursion
from tidemark.operators.evaluate import evaluate
from tidemark.operators.evaluate_groups import evaluate_by
from tidemark.operators.recursion import filtered


def walked(base, theta, new):
    q, past, out = theta.shape[1], np.zeros(theta.shape[1]), []
    for b, t, fresh in zip(base, theta, new):
        if fresh:
            past = np.zeros(q)
        e = 0.0 if b is None else b - float(t @ past)
        out.append(None if b is None else e)
        past = np.concatenate([[e], past[:-1]])
    return out


@pytest.mark.parametrize("q, fan, root", [(1, 1024, 0.5), (1, 3, 0.999), (2, 2, 0.99), (3, 1024, 1.0)])
def test_filter_equals_the_walk(spark, monkeypatch, q, fan, root):
    monkeypatch.setattr(recursion, "FAN", fan)
    rng = np.random.default_rng(q)
    n = 1500
    base = [None if rng.random() < 0.02 else float(v) for v in rng.normal(size=n)]
    weights = np.real(np.poly(root * np.exp(2j * np.pi * np.array([0.1, -0.1, 0])[:q] * (q > 1))))[1:] if q > 1 else np.array([-root])
    new = [i in (0, 700, 701) for i in range(n)]
    theta = np.array([weights * (1 if i < 700 else 0.5) for i in range(n)])
    rows = [(i, b, [float(x) for x in t], f) for i, (b, t, f) in enumerate(zip(base, theta, new))]
    df = spark.createDataFrame(rows, "row_id long, base double, theta array<double>, new boolean").repartition(4)
    got = filtered(df, n, "base", F.col("theta"), q, F.col("new"), size=64).toPandas().sort_values("row_id")
    want = walked(base, theta, new)
    assert len(got) == n
    # roots on the unit circle keep every rounding error for ever, so the two orders of summation part a little
    near = 1e-8 if root < 1 else 1e-6
    assert np.allclose(got["e"].to_numpy(float), np.array([np.nan if w is None else w for w in want]), rtol=near, atol=near, equal_nan=True)


def test_arima_with_a_root_outside_is_reflected():
    arima = registry.create("arima")
    assert np.allclose(arima._invertible(np.array([2.0])), [0.5])
    assert np.allclose(arima._invertible(np.array([0.99])), [0.99])
    for theta in ([1.5, 0.9], [-3.0, 2.0], [0.2, 2.0, 0.4]):
        fixed = arima._invertible(np.array(theta))
        assert np.abs(np.roots([1.0, *fixed])).max() <= 1 + 1e-9
        # autocovariances of both, up to one scale
        acov = lambda t: np.correlate([1.0, *t], [1.0, *t], "full")
        a, b = acov(theta), acov(fixed)
        assert np.allclose(a / a.max(), b / b.max())


def test_nearest_point_of_a_hull():
    rng = np.random.default_rng(4)
    for _ in range(30):
        points = rng.normal(size=(rng.integers(1, 30), 6)) + rng.normal(size=6)
        weights = nearest_to_origin(points)
        x = weights @ points
        assert weights.min() >= 0 and abs(weights.sum() - 1) < 1e-9
        assert (points @ x).min() >= x @ x - 1e-8  # no row lies on the near side of the plane through x


def test_svm_gap_and_optimum(spark):
    rng = np.random.default_rng(7)
    frame = make_frame(spark, np.vstack([rng.normal(size=(280, 3)), rng.normal(4, 1, size=(20, 3))]))
    loose, tight = (registry.create("one_class_svm", features=32, tolerance=t) for t in (0.05, 0.002))
    raw = {d.options["tolerance"]: d.raw_scores(frame).toPandas().sort_values("row_id")["raw"].to_numpy() for d in (loose, tight)}
    for d in (loose, tight):
        c = d.describe()["certificate"]
        assert 0 <= c["gap"] <= d.options["tolerance"] * abs(c["lower_bound"]) and c["objective"] - c["lower_bound"] == c["gap"]
    # bounds of both runs hold the same optimum
    assert tight.certificate["lower_bound"] >= loose.certificate["lower_bound"] - 1e-9
    assert max(loose.certificate["lower_bound"], tight.certificate["lower_bound"]) <= min(loose.certificate["objective"], tight.certificate["objective"])
    assert abs((raw[0.002] > 0).mean() - 0.1) < 0.02 and raw[0.002][280:].mean() > raw[0.002][:280].mean()


def scores(rng, n, kind):
    if kind == "flat":
        return np.full(n, 0.4)
    if kind == "few":
        return rng.choice([0.1, 0.5, 0.9], n)
    if kind == "high":
        return np.full(n, 0.8) + rng.random(n) / 10
    return rng.random(n) ** 3


@pytest.mark.parametrize("labelled", [True, False])
def test_metrics_of_all_segments_equal_one_by_one(spark, labelled):
    rng = np.random.default_rng(11)
    parts = []
    for k, (kind, n) in enumerate([("many", 3000), ("few", 50), ("flat", 20), ("high", 7), ("many", 1), ("few", 2), ("many", 200)]):
        label = rng.integers(0, 2, n) if k % 3 else np.zeros(n, int)
        parts.append(pd.DataFrame({"model": None if k == 6 else f"m{k}", "row_id": range(n), "score": scores(rng, n, kind), "label": label,
                                   "ts": pd.date_range("2024-01-01", periods=n, freq="7min")}))
    pdf = pd.concat(parts)
    df = spark.createDataFrame(pdf).withColumn("model", F.when(F.col("model") != "NaN", F.col("model"))).repartition(6)
    got = evaluate_by(df, ["model"], 0.5, labelled, True).toPandas()
    for part in parts:
        name, n = part["model"].iloc[0], len(part)
        own = evaluate(spark.createDataFrame(part.drop(columns="model")), n, 0.5, labelled, True).toPandas().set_index("metric")["value"]
        mine = got[got["model"].isna() if name is None else got["model"] == name].set_index("metric")["value"]
        assert sorted(own.index) == sorted(mine.index), name
        assert np.allclose(own[sorted(own.index)], mine[sorted(own.index)], rtol=1e-9, atol=1e-12, equal_nan=True), (name, own, mine)
