"""Models per series: the same as a run for each series alone, whatever the other series are."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.detectors import registry
from tidemark.detectors.per_series import raw_scores_by
from tidemark.frame import Frame
from tidemark.operators.evaluate import evaluate
from tidemark.operators.impute import impute, impute_by
from tidemark.operators.segments import segment
from tidemark.plans.pipeline import detect_series

SIZES = {"long": 2600, "a": 120, "b": 61, "short": 23, "tiny": 9, None: 300}


@pytest.fixture(scope="module")
def many():
    rng = np.random.default_rng(16)
    parts = []
    for k, (name, n) in enumerate(SIZES.items()):
        t = np.arange(n)
        y = 10 * k + 3 * np.sin(2 * np.pi * t / 12) + np.cumsum(rng.normal(0, 0.3, n)) + (t > n // 2) * k
        part = pd.DataFrame({"s": name, "row_id": t, "x": y, "z": 0.5 * y + rng.normal(0, 1, n), "u": rng.normal(5, 1, n)})
        part.loc[n // 3, "x"] += 25
        parts.append(part)
    return parts


def spark_frame(spark, parts):
    rows = [(None if isinstance(r.s, float) or r.s is None else r.s, int(r.row_id), float(r.x), float(r.z), float(r.u)) for p in parts for r in p.itertuples()]
    return spark.createDataFrame(rows, "s string, row_id long, x double, z double, u double").repartition(5)


@pytest.mark.parametrize("model, options", [
    ("pca", {}), ("pca", {"n_components": 1}), ("seasonal_decompose", {"period": 12}), ("seasonal_decompose", {"period": 7}), ("prophet", {}), ("arima", {}), ("arima", {"order": (2, 0, 0)}),
])
def test_equals_each_series_alone(spark, many, model, options):
    cols = ("x", "z", "u")
    segments = segment(spark_frame(spark, many), ["s"])
    got = segments.named(raw_scores_by(segments, cols, model, options)).toPandas()
    assert len(got) == sum(SIZES.values())
    for part in many:
        name, n = part["s"].iloc[0], len(part)
        if model in ("prophet", "arima") and n not in (120, 300, 23):  # one run of each kind is enough
            continue
        alone = Frame(spark_frame(spark, [part]).drop("s"), cols, n)
        want = registry.create(model, **options).raw_scores(alone).toPandas().sort_values("row_id")["raw"].to_numpy(float)
        mine = got[got["s"].isna() if name is None else got["s"] == name].sort_values("row_id")["raw"].to_numpy(float)
        assert np.allclose(mine, want, rtol=1e-5, atol=1e-6), (name, mine[:6], want[:6])


@pytest.mark.parametrize("strategy", ["mean", "median", "most_frequent", "constant", "drop"])
def test_imputes_like_each_series_alone(spark, many, strategy):
    holes = spark_frame(spark, many).withColumn("x", F.when(F.col("row_id") % 5 != 2, F.round("x"))).withColumn("z", F.when(F.col("row_id") % 4 != 1, F.round("z")))
    got = impute_by(holes, ["x", "z"], ["s"], strategy).toPandas()
    for name in ("a", "long"):
        want = impute(holes.where(F.col("s") == name), ["x", "z"], strategy).toPandas().sort_values("row_id")
        mine = got[got["s"] == name].sort_values("row_id")
        assert np.allclose(mine[["row_id", "x", "z"]].to_numpy(float), want[["row_id", "x", "z"]].to_numpy(float))
    if strategy in ("mean", "median"):
        with pytest.raises(ValueError):
            impute_by(holes.withColumn("x", F.when(F.col("s") != "a", F.col("x"))), ["x"], ["s"], strategy)


def test_one_plan_for_all(spark, many):
    df = spark_frame(spark, many).withColumn("bad", (F.col("row_id") == 7).cast("int")).withColumn("at", F.timestamp_seconds(F.col("row_id") * 60))
    found = detect_series(df, ["s"], ["row_id"], ["x", "z"], ["pca", "seasonal_decompose"], label_col="bad", ts="at", model_options={"seasonal_decompose": {"period": 12}}, scaling_method="standard")
    scores = found.scores.toPandas()
    assert len(scores) == 2 * sum(SIZES.values()) and scores["score"].between(0, 1).all()
    mine = found.scores.where("s = 'a' AND model = 'pca'")
    want = evaluate(mine, SIZES["a"], 0.5, True, True).toPandas().set_index("metric")["value"]
    got = found.metrics.where("s = 'a' AND model = 'pca'").toPandas().set_index("metric")["value"]
    assert sorted(want.index) == sorted(got.index) and np.allclose(got[sorted(got.index)], want[sorted(want.index)])
    assert found.metrics.select("s", "model").distinct().count() == 2 * len(SIZES)
    with pytest.raises(ValueError):
        detect_series(df, ["s"], ["row_id"], ["x"], ["isolation_forest"])


def test_summary_writes_counts_in_full():
    from tidemark.operators.evaluate import summary_text

    text = summary_text({"total_samples": 20012.0, "anomalies_detected": 123456.0, "auc_roc": 0.123456, "num_anomaly_episodes": 1234567.0})
    assert text.split("\n") == [
        "overall", "  total_samples: 20012", "  anomalies_detected: 123456", "with labels", "  auc_roc: 0.1235",
        "over time", "  num_anomaly_episodes: 1234567",
    ]


def test_products_come_without_a_python_object_per_row(spark):
    """Sums of products over blocks equal the plain ones; rows go to tasks as arrays, not as lists of structs."""
    from tidemark.detectors.per_series import products_by

    rng = np.random.default_rng(5)
    rows = [(int(k), int(k >= 40) + int(k >= 2500), None if k % 7 == 3 else float(rng.normal()), float(rng.normal())) for k in range(3000)]
    df = spark.createDataFrame(rows, "_pos long, _g long, x double, y double").repartition(6)
    made = products_by(df, 3000, ["x", "y"], lambda *x: np.stack(x, axis=1))
    assert "MapInPandas" not in made._jdf.queryExecution().toString()
    got = {r["_g"]: (r["rows"], {(c["i"], c["j"]): c["value"] for c in r["cells"]}) for r in made.collect()}
    assert sorted(got) == [0, 1, 2]
    for g, (n, cells) in got.items():
        v = np.array([r[2:] for r in rows if r[1] == g and r[2] is not None])
        assert n >= 1 and all(np.isclose((v.T @ v)[i, j], cells[i, j]) for i, j in ((0, 0), (0, 1), (1, 1)))
        assert n == len(v)
