"""Readers, end-to-end detection, selection rules, and the shape of the plans."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.detectors import registry
from tidemark.frame import Frame
from tidemark.operators import evaluate
from tidemark.operators.features import interaction_features, rolling_features
from tidemark.operators.order import number_rows
from tidemark.plans import pipeline, selection
from tidemark.sources import readers
from tidemark.sources.schemas import LOG_FAMILIES


@pytest.fixture(scope="module")
def host():
    """Host metrics with two injected plateaus."""
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({
        "timestamp": pd.date_range("2023-01-01", periods=200, freq="h"),
        "cpu_usage": rng.normal(50, 10, 200), "memory_usage": rng.normal(60, 15, 200),
        "network_traffic": rng.normal(1000, 200, 200),
    })
    pdf.loc[50:54, "cpu_usage"] = 95.0
    pdf.loc[100:104, "memory_usage"] = 95.0
    pdf["truth"] = 0
    pdf.loc[50:54, "truth"] = 1
    return pdf


def test_detect_end_to_end(spark, host, tmp_path):
    found = pipeline.detect(
        spark.createDataFrame(host), models=["isolation_forest", "pca", "seasonal_decompose"],
        label_col="truth", output=str(tmp_path / "out"),
    )
    pdf = found.scores.toPandas()
    assert pdf.groupby("model").size().tolist() == [200, 200, 200]
    assert pdf["score"].between(0, 1).all() and (pdf["score"] > 0.7).any()
    assert pdf["ts"].notna().all()
    summary = found.summary.toPandas().set_index("model")
    assert set(summary.columns) == {"anomalies_detected", *evaluate.SUMMARY_METRICS}
    assert summary["auc_roc"].notna().all()
    back = spark.read.json(str(tmp_path / "out" / "scores"))
    assert back.count() == 600
    assert spark.read.csv(str(tmp_path / "out" / "summary"), header=True).count() == 3


def test_failed_model_is_recorded(spark, host):
    found = pipeline.detect(
        spark.createDataFrame(host.drop(columns="truth")), models=["pca", "seasonal_decompose"],
        model_options={"seasonal_decompose": {"model": "multiplicative", "period": 24}},
    )
    audit = {r["model"]: r["status"] for r in found.audit.collect()}
    assert audit == {"pca": "ok", "seasonal_decompose": "failed"}
    row = found.summary.first()
    assert row["model"] == "pca" and row["auc_roc"] is None  # no labels: NULL, not 0


def test_failed_model_raises_unless_asked_for(spark, monkeypatch):
    from catalog import models

    frame = Frame(spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "row_id long, x double"), ("x",), 60, None)
    registry_create = registry.create

    def no_mixture(name, **options):
        made = registry_create(name, **options)
        if name == "gaussian_mixture":
            made.fit_predict = lambda _: (_ for _ in ()).throw(RuntimeError("an executor was lost"))
        return made

    monkeypatch.setattr(registry, "create", no_mixture)
    monkeypatch.setattr(models, "lines", lambda spark, sf: frame)
    with pytest.raises(pipeline.ModelsFailed, match="an executor was lost") as raised:
        models.detect_many_models(spark, None)
    assert [(a[0], a[1]) for a in raised.value.audit] == [("isolation_forest", "ok"), ("pca", "ok"), ("gaussian_mixture", "failed")]
    scores, audit = pipeline.run_models(frame, ["pca", "gaussian_mixture"], skip_failed=True)
    assert scores.count() == 60 and [r["status"] for r in audit.collect()] == ["ok", "failed"]


def test_unknown_names_raise(spark, host):
    df = spark.createDataFrame(host)
    with pytest.raises(ValueError):
        pipeline.detect(df, models=["no_such_model"])
    with pytest.raises(ValueError):
        pipeline.prepare(df, window=3)
    with pytest.raises(ValueError):
        pipeline.detect(df, models=["pca"], export_format="xml")


def test_prepare_shapes(spark, host):
    df = spark.createDataFrame(host.drop(columns="truth"))
    p = pipeline.prepare(df, add_interaction_features=True)
    engineered = 3 + 3 * 5 + 8
    assert len(p.frame.features) == engineered + engineered * (engineered - 1) // 2
    named = pipeline.prepare(df, add_interaction_features=True, interaction_columns=["cpu_usage", "memory_usage", "cpu_usage_lag_1"])
    assert named.frame.features[engineered:] == ("cpu_usage_x_memory_usage", "cpu_usage_x_cpu_usage_lag_1", "memory_usage_x_cpu_usage_lag_1")
    with pytest.raises(ValueError):
        pipeline.prepare(df, add_interaction_features=True, interaction_columns=["no_such"])
    with pytest.raises(ValueError):
        interaction_features(df, [f"c{i}" for i in range(200)])
    stats = p.frame.df.agg(*[F.avg(c).alias(c) for c in p.frame.features]).first()
    assert max(abs(v) for v in stats) < 1e-9
    reduced = pipeline.prepare(df, apply_pca=True)
    assert reduced.frame.features[0] == "PC_1" and reduced.summary["explained_variance"] > 0.95


def test_drop_removes_rows_once(spark):
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=20, freq="min"), "x": np.arange(20.0)})
    rows = [(t.to_pydatetime(), None if i in (3, 4) else float(x)) for i, (t, x) in enumerate(zip(pdf["ts"], pdf["x"]))]
    df = spark.createDataFrame(rows, "ts timestamp, x double")
    p = pipeline.prepare(df, missing_strategy="drop", feature_engineering=False)
    assert p.frame.n == 18 and p.frame.df.count() == 18
    assert p.frame.df.agg(F.max("row_id")).first()[0] == 17


def test_files_are_independent(spark, tmp_path, host):
    paths = []
    for i, part in enumerate((host.iloc[:120], host.iloc[120:])):
        path = str(tmp_path / f"f{i}.csv")
        part.drop(columns="truth").to_csv(path, index=False)
        paths.append(path)
    out = pipeline.detect_files(spark, paths, models=["pca"])
    assert [out[p].scores.count() for p in paths] == [120, 80]


def test_readers_guard_and_detect(spark, tmp_path):
    path = str(tmp_path / "empty.csv")
    pd.DataFrame({"a": [], "b": []}).to_csv(path, index=False)
    with pytest.raises(ValueError):
        readers.read_events(spark, path)
    df = spark.createDataFrame([("x", "2024-01-01 10:00:00"), ("y", "2024-01-02")], "name string, noted string")
    assert readers.detect_timestamp(df) == "noted"
    assert readers.detect_timestamp(df.select("name")) is None
    with pytest.raises(ValueError):
        readers.read_table(spark, "data.xyz")
    with pytest.raises(ValueError):
        LOG_FAMILIES["netflow"].check(["timestamp", "src_ip"])
    assert LOG_FAMILIES["auth"].optional == ("src_ip", "success", "session_id")


def test_tsv_comments(spark, tmp_path):
    path = str(tmp_path / "conn.tsv")
    with open(path, "w") as f:
        f.write("#fields below\nts\tbytes\n2024-01-01 00:00:00\t5\n#close\n")
    assert readers.read_events(spark, path).select("bytes", "hour").collect() == [(5, 0)]


# ---------------------------------------------------------------- selection


META = {"n_samples": 20_000.0, "n_features": 12.0, "dimensionality_ratio": 0.0006, "outlier_fraction": 0.2,
        "series_like": 1.0, "clustering_tendency": 0.7}


def test_rules():
    names = registry.names()
    assert selection.metaod(META, names) == [
        "isolation_forest", "local_outlier_factor", "dbscan", "one_class_svm", "lstm_autoencoder", "prophet"
    ]
    assert selection.orthus(META, names) == ["isolation_forest", "gaussian_mixture", "lstm_autoencoder", "prophet"]
    quiet = {**META, "n_samples": 50.0, "outlier_fraction": 0.0, "series_like": 0.0, "clustering_tendency": 0.1}
    assert selection.metaod(quiet, names) == ["isolation_forest"]
    assert selection.orthus(quiet, names) == ["isolation_forest", "dbscan", "autoencoder"]
    assert selection.fit_bounds({"prophet"}, names, META) == ["prophet", "isolation_forest"]
    assert selection.rank(["prophet", "pca", "isolation_forest", "lstm_autoencoder"], META) == [
        "isolation_forest", "lstm_autoencoder", "pca", "prophet"
    ]


def test_selection_bounds(spark):
    rng = np.random.default_rng(42)
    x = pd.DataFrame(rng.normal(size=(100, 8)), columns=[f"f{i}" for i in range(8)])
    x.insert(0, "row_id", np.arange(100))
    f = Frame(spark.createDataFrame(x), tuple(x.columns[1:]), 100)
    meta = selection.meta_features(f)
    assert meta["n_samples"] == 100 and meta["n_features"] == 8
    given = ["isolation_forest", "pca", "local_outlier_factor", "dbscan"]
    chosen = selection.select_models(f, given, methods=("metaod", "orthus"), max_models=3, meta=meta)
    assert 2 <= len(chosen) <= 3 and set(chosen) <= set(given)
    assert selection.select_models(f, given, enabled=False) == given
    assert 0.3 < meta["clustering_tendency"] < 0.8
    names = [r["model"] for r in selection.recommend(spark, meta, 3).collect()]
    assert len(names) == 3 and names[0] == "isolation_forest"
    fits = {r["model"] for r in selection.compatible(spark, {"n_samples": 5.0, "n_features": 1.0}).collect()}
    assert not fits


def test_meta_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=(300, 2)), axis=0)
    pdf = pd.DataFrame(x, columns=["a", "b"])
    pdf.insert(0, "row_id", np.arange(300))
    got = selection.order_features(Frame(spark.createDataFrame(pdf), ("a", "b"), 300))
    noise = np.diff(x, axis=0).std(0).mean()
    assert np.isclose(got["noise_level"], noise)
    assert np.isclose(got["signal_to_noise_ratio"], x.var(0).mean() / noise**2)
    assert got["series_like"] == 1.0


def test_significance():
    # two-sided p of t = 2.0 with 10 degrees of freedom
    assert math.isclose(selection.incomplete_beta(5, 0.5, 10 / (10 + 4.0)), 0.07338803, rel_tol=1e-6)
    assert not selection.is_series_like(0.35, 20) and selection.is_series_like(0.35, 200)
    assert not selection.is_series_like(0.9, 9) and not selection.is_series_like(None, 100)


# ---------------------------------------------------------------- plans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ordered_features_never_use_one_partition(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    placed, n = number_rows(e.select("ts", "event_id", "value"), ["ts", "event_id"])
    for df in (placed, rolling_features(placed, ["value"], n)):
        assert "SinglePartition" not in plan_of(df)
        assert "CartesianProduct" not in plan_of(df) and "NestedLoop" not in plan_of(df)


def test_copies_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.array((F.col("id") % 3).cast("double")).alias("v"))
    w = Window.partitionBy("v").orderBy("row_id")
    plan = plan_of(df.repartition(4).withColumn("r", F.row_number().over(w)).where("r <= 3"))
    assert plan.count("WindowGroupLimit") == 2  # before and after the exchange


def test_columns_are_pruned(spark, sf):
    e = readers.read_events(spark, f"{sf}/events.parquet")
    plan = plan_of(e.where(F.col("value") > 10).select("value", "hour"))
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "props" not in scan.split("ReadSchema")[1] and "GreaterThan(value,10" in scan


def test_hopkins_against_all_distances(spark):
    """More rows than are compared at once, copies among them, and probes that are rows of the table."""
    import hashlib

    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 3))
    x[:50] = x[0]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double, c double")
    own = sorted(range(700), key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i))[:20]
    share = np.array([[int(hashlib.md5(f"42|{i}|{r}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(3)] for r in own])
    lo, hi = x[own].min(0), x[own].max(0)
    d = lambda p: np.sqrt(((x - p) ** 2).sum(1))
    w = sum(np.delete(d(x[r]), r).min() for r in own)
    u = sum(d(p).min() for p in lo + (hi - lo) * share)
    for parts in (1, 5):
        got = selection.hopkins(Frame(df.repartition(parts), ("a", "b", "c"), 700), probes=20)
        assert got == pytest.approx(u / (w + u), rel=1e-12)
