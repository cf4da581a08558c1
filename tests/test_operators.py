"""Building blocks on hand-checked rows, hot keys, and against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.detectors.ensemble import combine
from tidemark.functions import scalars
from tidemark.operators import evaluate, knn_impute, neighbours, runs, sequences, series
from tidemark.operators.encode import encode_category
from tidemark.operators.features import feature_columns
from tidemark.operators.impute import impute
from tidemark.operators.linalg import components_for, fit_pca
from tidemark.operators.order import number_rows, over_blocks, prefix_sums, running_totals
from tidemark.operators.quantile import quantiles, quantiles_by
from tidemark.operators.sampling import md5_sample
from tidemark.operators.scale import scale, scale_by
from tidemark.operators.skew import join_unique


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def test_ip_to_numeric(spark):
    ips = ["192.168.1.1", "10.0.0.1", None, "a.b.c.d", "1.2.3", "1.2.3.4.5", "300.1.1.1"]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i int, ip string")
    got = [r[0] for r in df.orderBy("i").select(scalars.ip_to_numeric(F.col("ip"))).collect()]
    assert got == [3232235777, 167772161, 0, 0, 0, 0, 300 * 256**3 + 65536 + 256 + 1]


def test_error_flag_and_codes(spark):
    df = spark.createDataFrame([("Login FAILED",), ("ok",), (None,)], "m string")
    assert [r[0] for r in df.select(scalars.has_error(F.col("m"))).collect()] == [1, 0, 0]
    codes = encode_category(spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "B")], "i int, c string"), "c")
    assert [r["c_encoded"] for r in codes.orderBy("i").collect()] == [2, -1, 1, 0]


def test_feature_roles(spark):
    df = spark.createDataFrame([], "ts timestamp, user_id bigint, width double, flow double, ok boolean, name string")
    assert feature_columns(df, "ts") == ["flow"]  # "width" contains an id word
    assert feature_columns(df, "ts", "suffix") == ["width", "flow"]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_positions_do_not_depend_on_partitions(spark, parts):
    rng = np.random.default_rng(1)
    key = np.where(rng.random(3000) < 0.4, 7, rng.integers(0, 50, 3000))  # one hot leading key
    df = frame(spark, k=key, tie=rng.permutation(3000)).repartition(parts)
    got, n = number_rows(df, ["k", "tie"])
    pdf = got.toPandas().sort_values("row_id")
    assert n == 3000
    assert pdf["row_id"].tolist() == list(range(3000))
    assert pdf[["k", "tie"]].values.tolist() == pdf.sort_values(["k", "tie"])[["k", "tie"]].values.tolist()


def test_positions_per_series(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, s=rng.choice(["a", "b", "c"], 500, p=[0.8, 0.15, 0.05]), t=rng.permutation(500))
    pdf = number_rows(df, ["t"], ["s"])[0].toPandas()
    want = pdf.sort_values("t").groupby("s").cumcount()
    assert (pdf.loc[want.index, "row_id"] == want).all()


@pytest.mark.parametrize("size", [7, 64, 5000])
def test_block_windows_equal_a_global_window(spark, size):
    rng = np.random.default_rng(3)
    y = rng.normal(size=400)
    df = frame(spark, row_id=np.arange(400), y=y)
    out = over_blocks(df, 400, {"m": lambda w: F.avg("y").over(w.rowsBetween(-9, 3))}, 9, 3, size=size).toPandas()
    want = [y[max(0, i - 9): i + 4].mean() for i in range(400)]
    assert np.allclose(out.sort_values("row_id")["m"], want)


def test_running_totals_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 9, 5000)
    df = frame(spark, row_id=np.arange(5000), y=y)
    assert prefix_sums(df, ["row_id"], {"t": "y"}).toPandas().sort_values("row_id")["t"].tolist() == y.cumsum().tolist()
    monkeypatch.setattr("tidemark.operators.order.DRIVER_BLOCKS", 2)  # totals of totals
    got = running_totals(df, 5000, {"t": "y"}).toPandas().sort_values("row_id")["t"]
    assert got.tolist() == y.cumsum().tolist()


@pytest.mark.parametrize("small", [10, 100, 10_000_000])
def test_quantiles_with_a_hot_value(spark, small):
    rng = np.random.default_rng(5)
    x = np.where(rng.random(4000) < 0.35, 1.5, rng.normal(size=4000))
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = quantiles(frame(spark, x=x), ["x"], probs, small=small)["x"]
    assert np.allclose(got, np.percentile(x, [p * 100 for p in probs]))


def test_quantiles_by_series(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"s": rng.choice(list("ab"), 900, p=[0.9, 0.1]), "x": rng.normal(size=900)})
    got = quantiles_by(spark.createDataFrame(pdf), ["s"], "x", {"q": 0.37}).toPandas().set_index("s")["q"]
    for s, part in pdf.groupby("s"):
        assert np.isclose(got[s], np.percentile(part["x"], 37))


def test_quantile_of_nothing(spark):
    assert quantiles(spark.createDataFrame([(None,)], "x double"), ["x"], [0.5]) == {"x": [None]}


def brute_knn(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:k]
        out[i] = [(j, d[i, j]) for j in order]
    return out


@pytest.mark.parametrize("d", [2, 8])
def test_knn_with_a_third_of_copies(spark, d, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_CHUNK", 16)
    monkeypatch.setattr(neighbours, "REF_CHUNK", 24)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, d))
    x[rng.permutation(240)[:80]] = 0.25  # a hot group of identical rows
    x[200:] += 8.0  # and a far cluster
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "row_id bigint, v array<double>")
    got = neighbours.knn_join(df, F.col("v"), 6).toPandas()
    want = brute_knn(x, 6)
    assert len(got) == 240 * 6
    for i, part in got.sort_values("rank").groupby("row_id"):
        assert part["nbr_id"].tolist() == [j for j, _ in want[i]]
        assert np.allclose(part["dist"], [dist for _, dist in want[i]])
    counts = neighbours.radius_counts(df, F.col("v"), 1.0).toPandas().set_index("row_id")["n"]
    near = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 1.0).sum(1)
    assert counts.sort_index().tolist() == near.tolist()


def test_knn_within_radius(spark):
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0, 1, 2, 10])], "pid bigint, v array<double>")
    refs = df.withColumn("ids", F.array("pid"))
    got = neighbours.knn_points(df, refs, 4, 3, radius=1.0).toPandas()
    assert sorted(zip(got["pid"], got["nbr"])) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_knn_impute_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 3))
    x[:30] = x[0]  # copies as donors
    hole = rng.random(x.shape) < 0.15
    hole[:, 0] = False
    y = np.where(hole, np.nan, x)
    rows = [(i, *[None if np.isnan(a) else float(a) for a in v]) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "row_id bigint, a double, b double, c double")
    got = impute(df, ["a", "b", "c"], "knn").toPandas().sort_values("row_id")[["a", "b", "c"]].to_numpy()
    for i, j in zip(*np.nonzero(hole)):
        donors = []
        for o in range(90):
            shared = ~np.isnan(y[i]) & ~np.isnan(y[o])
            if o != i and not np.isnan(y[o, j]) and shared.any():
                donors.append((np.sqrt(3 / shared.sum() * ((y[i] - y[o])[shared] ** 2).sum()), o))
        assert np.isclose(got[i, j], np.mean([y[o, j] for _, o in sorted(donors)[:5]])), (i, j)


def test_knn_impute_leaves_far_chunks_alone(spark, monkeypatch):
    """Clusters, several classes of missing columns, ties and a row with nothing: the brute force's answers from few pairs."""
    monkeypatch.setattr(knn_impute, "QUERY_CHUNK", 8)
    monkeypatch.setattr(knn_impute, "DONOR_CHUNK", 16)
    rng = np.random.default_rng(18)
    n = 600
    x = np.round(rng.normal(size=(n, 4)) + 40 * rng.integers(0, 8, (n, 1)), 1)
    y = np.where(rng.random(x.shape) < 0.12, np.nan, x)
    y[5] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(a) else float(a) for a in v]) for i, v in enumerate(y)], "row_id bigint, a double, b double, c double, d double").repartition(4)
    got = impute(df, list("abcd"), "knn").toPandas().sort_values("row_id")[list("abcd")].to_numpy()
    known = ~np.isnan(y)
    for i, j in zip(*np.nonzero(~known)):
        shared = (known[i] & known).sum(1)
        usable = [o for o in range(n) if o != i and known[o, j] and shared[o]]
        dist = {o: np.sqrt(4 / shared[o] * ((y[i] - y[o])[known[i] & known[o]] ** 2).sum()) for o in usable}
        near = sorted(usable, key=lambda o: (dist[o], o))[:5]
        want = np.mean([y[o, j] for o in near]) if near else np.nanmean(y[:, j])
        assert np.isclose(got[i, j], want), (i, j)
    patterns, _ = knn_impute.indexed_patterns(df, list("abcd"))
    left = patterns.where("contains(mask, '0')").selectExpr("v", "ids", "mask", "floor(_at / 8) AS chunk")
    right = patterns.selectExpr("v", "ids", "mask", "floor(_at / 16) AS chunk")
    met = knn_impute.chunk_pairs(left, right, 4).count()
    whole = left.select("mask", "chunk").distinct().count() * right.select("mask", "chunk").distinct().count()
    assert met < 0.5 * whole


def test_impute_strategies(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, None), (3, 4.0), (4, 4.0), (5, 10.0)], "row_id bigint, x double")
    value = {s: impute(df, ["x"], s).where("row_id = 2").first()["x"] for s in ("mean", "median", "most_frequent", "constant")}
    assert value == {"mean": 4.0, "median": 4.0, "most_frequent": 1.0, "constant": 0.0}
    assert impute(df, ["x"], "drop").count() == 5
    with pytest.raises(ValueError):
        impute(df, ["x"], "nothing")
    with pytest.raises(ValueError):
        impute(spark.createDataFrame([(0, None)], "row_id bigint, x double"), ["x"], "mean")


def test_constant_columns_scale_to_zero(spark):
    df = frame(spark, x=[3.1, 3.1, 3.1], s=["a", "a", "b"])
    for method in ("standard", "minmax", "robust"):
        assert [r["x"] for r in scale(df, ["x"], method).collect()] == [0.0, 0.0, 0.0]
        assert [r["x"] for r in scale_by(df, ["x"], ["s"], method).collect()] == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        scale(df, ["x"], "other")


@pytest.mark.parametrize("d", [3, 20])
def test_pca_against_numpy(spark, d):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, d)) + 0.05 * rng.normal(size=(200, d)) + 100
    cols = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols))
    model = fit_pca(df, cols, 0.95)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    values = values[::-1]
    assert np.allclose(model.variances, values, rtol=1e-6, atol=1e-9)
    assert model.k == components_for(values / values.sum(), 0.95)
    top = vectors[:, ::-1][:, : model.k]
    centred = x - x.mean(0)
    want = ((centred - centred @ top @ top.T) ** 2).mean(1)
    assert np.allclose(model.with_residual(df).toPandas()["raw"], want, atol=1e-8)
    assert np.allclose(np.abs(model.transform(df).toPandas()["PC_1"]), np.abs(centred @ top[:, 0]), atol=1e-6)
    assert list(model.importance().values()) == sorted(model.importance().values(), reverse=True)


def test_components_rule():
    assert components_for(np.array([0.5, 0.45, 0.05]), 0.95) == 3  # must exceed
    assert components_for(np.array([0.5, 0.45, 0.05]), 0.9) == 2
    assert components_for(np.array([0.5, 0.5]), 0.5, inclusive=True) == 1


def scored(spark, preds):
    ts = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(len(preds)), unit="s")
    return frame(spark, row_id=np.arange(len(preds)), ts=ts, score=np.array(preds, dtype=float))


def test_episodes_consistency_spread(spark):
    df = scored(spark, [0, 1, 1, 0, 1])
    flagged = df.withColumn("pred", F.col("score").cast("int"))
    eps = runs.episodes(flagged, 5).orderBy("run_id").toPandas()
    assert eps["seconds"].tolist() == [2.0, 0.0]
    assert evaluate.consistency(df, 5).first()[0] == 0.25
    assert evaluate.spread(flagged, 5).first()[0] == 0.75
    got = evaluate.temporal(df, 5).first()
    assert (got["avg_time_between_anomalies"], got["num_anomaly_episodes"]) == (1.5, 2)


def test_no_anomalies(spark):
    got = evaluate.temporal(scored(spark, [0, 0, 0]), 3).first()
    assert got["num_anomaly_episodes"] == 0
    assert got["avg_time_between_anomalies"] is None and got["anomaly_temporal_spread"] is None


def test_curves_on_ties_and_single_class(spark):
    df = frame(spark, score=[0.1, 0.4, 0.4, 0.8], label=[0, 0, 1, 1])
    row = evaluate.curve_metrics(df).first()
    assert np.isclose(row["auc_roc"], 0.875)
    assert np.isclose(row["auc_pr"], 0.5 * 1.0 + 0.5 * (2 / 3))
    assert evaluate.curve_metrics(frame(spark, score=[0.1, 0.2], label=[0, 0])).first()["auc_roc"] == 0.0
    assert evaluate.curve_metrics(frame(spark, score=[0.1, 0.2], label=[1, 1])).first()["auc_roc"] == 0.0


def test_constant_scores(spark):
    df = frame(spark, row_id=[0, 1, 2], score=[0.3, 0.3, 0.3])
    row = evaluate.distribution(df).first()
    assert (row["score_entropy"], row["score_skewness"], row["score_kurtosis"]) == (0.0, 0.0, 0.0)
    assert evaluate.synthetic(df).first()["synthetic_auc"] == 0.0


def test_event_f1(spark):
    df = frame(spark, row_id=range(8), score=[0, 1, 0, 0, 1, 0, 0, 1], label=[1, 1, 0, 1, 0, 0, 0, 0])
    row = evaluate.event_f1(df, 8).first()
    assert (row["true_events"], row["pred_events"]) == (2, 3)
    assert np.isclose(row["event_recall"], 0.5) and np.isclose(row["event_precision"], 1 / 3)


def test_ensembles_exact(spark):
    a, b = [0.04, 0.5, 0.62], [0.16, 0.38, 0.94]
    long = spark.createDataFrame(
        [(i, m, s) for m, v in (("a", a), ("b", b)) for i, s in enumerate(v)], "row_id int, model string, score double"
    )
    got = {m: [r["score"] for r in combine(long, m).orderBy("row_id").collect()] for m in ("average", "max", "median", "other")}
    assert np.allclose(got["average"], [0.1, 0.44, 0.78])
    assert np.allclose(got["max"], [0.16, 0.5, 0.94])
    assert np.allclose(got["median"], got["average"]) and np.allclose(got["other"], got["average"])
    weighted = combine(long, "weighted", {"a": 3.0, "b": 1.0}).orderBy("row_id").collect()
    assert np.isclose(weighted[0]["score"], 0.07)


@pytest.mark.parametrize("window", [2, 5, 300])
def test_centred_average_against_pandas(spark, window):
    y = np.random.default_rng(10).normal(size=900)
    got = series.centred_average(frame(spark, row_id=np.arange(900), y=y), 900, window).toPandas()
    want = pd.Series(y).rolling(window, center=True).mean().bfill().ffill()
    assert np.allclose(got.sort_values("row_id")["moving_avg"], want)


def test_period_and_autocorrelation(spark, monkeypatch):
    monkeypatch.setattr(series, "FIRST_LAGS", 8)  # several rounds
    y = np.sin(2 * np.pi * np.arange(600) / 37)
    df = frame(spark, row_id=np.arange(600), y=y)
    assert series.detect_period(df, 600) == 37
    part = series.autocorrelation(df, 600, 30, 45).orderBy("lag").toPandas()
    assert np.allclose(part["value"], [(y[: 600 - k] * y[k:]).sum() for k in range(30, 46)])
    flat = frame(spark, row_id=np.arange(50), y=np.ones(50))
    assert series.detect_period(flat, 50) == 5  # no peak: a tenth


def test_first_peak():
    assert series.first_peak(np.array([5.0, 1, 3, 3, 3, 1]), 0) == 3  # plateau: its middle
    assert series.first_peak(np.array([5.0, 4, 3]), 0) is None
    assert series.first_peak(np.array([0.0, 1, 0, 9, 0]), 2) == 3


def test_multiplicative_needs_positive_values(spark):
    with pytest.raises(ValueError):
        series.decompose(frame(spark, row_id=[0, 1, 2], y=[1.0, -1.0, 2.0]), 3, 2, "multiplicative")


def test_sequences_and_padding(spark):
    df = frame(spark, row_id=np.arange(6), y=np.arange(6.0))
    win = sequences.sliding_windows(df, 6, 3, F.col("y")).orderBy("row_id").collect()
    assert [list(r["window"]) for r in win] == [[0, 1, 2], [1, 2, 3], [2, 3, 4], [3, 4, 5]]
    scored_rows = sequences.sliding_windows(df, 6, 3, F.col("y")).select("row_id", F.col("window")[2].alias("raw"))
    padded = sequences.pad_scores(df, 6, scored_rows, 3).orderBy("row_id")
    assert [r["raw"] for r in padded.collect()] == [2.0, 2.0, 2.0, 3.0, 4.0, 5.0]
    assert sequences.sliding_windows(df, 6, 7, F.col("y")).count() == 0


def test_sample_is_the_same_with_prefilter(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    a = {r["row_id"] for r in md5_sample(df, "row_id", 50, 5000).collect()}
    b = {r["row_id"] for r in md5_sample(df, "row_id", 50, 1).collect()}  # n below size: no prefilter
    assert a == b and len(a) == 50


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr("tidemark.operators.skew.HOT_PARTS", 10)
    left = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5000).alias("k"))
    right = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = join_unique(left, right, "k", 60_000)
    assert out.count() == 60_000
    assert out.where("v <> 2 * k").count() == 0


def test_far_clusters_leave_empty_groups(spark, monkeypatch):
    """Groups that no reference row reaches must not break the join."""
    monkeypatch.setattr(neighbours, "REF_CHUNK", 8)
    rng = np.random.default_rng(11)
    x = np.concatenate([c * 100.0 + rng.normal(size=(30, 2)) for c in range(6)])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "pid bigint, v array<double>")
    refs = df.withColumn("ids", F.array("pid")).withColumn("copies", F.lit(1))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = neighbours.knn_points(df, refs, 180, 4, radius=0.5).groupBy("pid").count().toPandas().set_index("pid")["count"]
    assert near.sort_index().tolist() == np.minimum((d <= 0.5).sum(1), 4).tolist()
    counts = neighbours.radius_counts_points(df, refs, 180, 0.5).toPandas().set_index("pid")["n"]
    assert counts.sort_index().tolist() == (d <= 0.5).sum(1).tolist()
    links = neighbours.radius_links(df.withColumn("node", F.col("pid")), 180, 0.5).toPandas()
    assert (d[links["a"], links["b"]] >= 0).all() and (links["a"] // 30 == links["b"] // 30).all()


def test_areas_with_many_rows_of_both_classes(spark, monkeypatch):
    """Counts whose product leaves 32 bits."""
    from tidemark.operators import evaluate

    points = spark.createDataFrame(
        [(0.2, 0, 90_000, 0, 90_000), (0.8, 100_000, 10_000, 100_000, 100_000)], "score double, pos bigint, neg bigint, pos_upto bigint, neg_upto bigint"
    )
    monkeypatch.setattr(evaluate, "curve_points", lambda df: points)
    row = evaluate.curve_metrics(points).first()
    assert row["auc_roc"] == pytest.approx(0.9 + 0.1 / 2)
    assert row["auc_pr"] == pytest.approx(100_000 / 110_000)


@pytest.mark.parametrize("n", [100, 2_000, 30_000])
def test_every_tree_has_its_full_sample(spark, n):
    from tidemark.detectors.statistical import IsolationForest
    from tidemark.frame import Frame

    frame = Frame(spark.range(n).selectExpr("id AS row_id", "double(id) AS x"), ("x",), n)
    nodes = IsolationForest(n_estimators=10, max_samples=256).fit(frame)
    # with distinct values every leaf above the depth limit holds one row; the root of each tree has psi rows
    assert sorted(nodes["tree"].unique()) == list(range(10))
    psi = min(256, n)
    assert (nodes.groupby("tree").size() >= psi / 2).all()


def test_timestamp_needs_every_value(spark):
    from tidemark.sources.readers import detect_timestamp

    rows = [("2024-01-01 00:00:00", "2024-01-01", None)] * 6 + [("no date", "2024-01-02", None)] * 3
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert detect_timestamp(df) == "b"
    assert detect_timestamp(df.select("a", "c")) is None


def test_codes_of_large_dictionaries(spark, monkeypatch):
    from tidemark.operators import encode

    monkeypatch.setattr(encode, "BROADCAST_ROWS", 2)
    rows = [("b",), (None,), ("a",), ("B",), ("a",), (None,)]
    got = encode.encode_category(spark.createDataFrame(rows, "v string"), "v").collect()
    assert sorted((str(r.v), r.v_encoded) for r in got) == [("B", 0), ("None", -1), ("None", -1), ("a", 1), ("a", 1), ("b", 2)]


def test_quantiles_of_a_value_that_most_rows_have(spark):
    pdf = pd.DataFrame({"s": ["a"] * 900 + ["b"] * 4 + [None] * 4, "x": [0.0] * 850 + list(range(50)) + [1.0, 5.0, 2.0, 2.0] + [3.0, 1.0, 2.0, 2.0]})
    got = {r["s"]: r["q"] for r in quantiles_by(spark.createDataFrame(pdf, "s string, x double"), ["s"], "x", {"q": 0.97}).collect()}
    want = {"a": np.quantile(pdf.x[:900], 0.97), "b": np.quantile([1.0, 5.0, 2.0, 2.0], 0.97), None: np.quantile([3.0, 1.0, 2.0, 2.0], 0.97)}
    assert got == pytest.approx(want)


def test_scale_by_equals_scale_of_each_series(spark):
    pdf = pd.DataFrame({"s": ["a"] * 5 + ["b"] * 4, "x": [0.1] * 5 + [1.0, 2.0, 4.0, 8.0]})
    df = spark.createDataFrame(pdf)
    for method in ("standard", "minmax", "robust"):
        got = sorted((r["s"], r["x"]) for r in scale_by(df, ["x"], ["s"], method).collect())
        want = sorted((s, r["x"]) for s in "ab" for r in scale(df.where(F.col("s") == s), ["x"], method).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want])
        assert str(got[0][1]) == "0.0"


def test_tables_of_a_block_go_with_it(spark):
    import os

    from tidemark.session import discard, disposable, materialise

    with disposable(spark) as keep:
        with disposable(spark) as inner:
            a, b = materialise(spark.range(3), "a"), inner(materialise(spark.range(4), "b"))
        c = keep(materialise(b.selectExpr("id + 1 AS id"), "c"))
    there = [os.path.isdir(x.written_to.removeprefix("file:")) for x in (a, b, c)]
    assert there == [False, False, True] and c.count() == 4
    discard(c)
    assert not os.path.isdir(c.written_to.removeprefix("file:"))


def test_references_are_sent_once_per_large_chunk():
    """In 64 dimensions the copies of a row that a join sends stay few as the table grows."""
    from tidemark.operators.neighbours import _chunk_rows, _layout

    for n, most in ((10_000, 8), (120_000, 24), (720_000, 64)):
        rows, bins = _chunk_rows(64, n)
        assert 8 * 64 * max(rows, bins) <= 16 << 20
        pivots = np.random.default_rng(1).normal(size=(max(1, n // (4 * rows)), 64))
        each = pd.DataFrame({"cell": range(len(pivots)), "n": n // len(pivots), "far": 9.0})
        layout = _layout(pivots, each, each, pd.DataFrame({"cell": [], "far": []}), None, 1e9, n)
        assert layout.q_chunks.sum() + layout.n_bins <= most
    assert _chunk_rows(2, 10**9) == (2048, 8192)


def test_rounded_by_arithmetic(spark):
    from tidemark.functions.scalars import rounded

    values = [0.0, -0.0, 0.25, -0.25, 1.005, 2.5, -2.5, 1e-9, -1e-9, 123456.654321, 1e300, -1e300, 4.6e15, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", rounded(F.col("v"), 1).alias("r"))
    assert "round(" not in df._jdf.queryExecution().optimizedPlan().toString().lower().replace("rounded", "")
    got = [r.r for r in df.collect()]
    want = [0.0, 0.0, 0.3, -0.3, 1.0, 2.5, -2.5, 0.0, 0.0, 123456.7, 1e300, -1e300, 4.6e15, float("inf")]
    assert [str(g) for g in got[:14]] == [str(w) for w in want] and got[14] != got[14] and got[15] is None


def test_numbering_writes_only_what_is_carried(spark, monkeypatch):
    from tidemark.frame import Frame
    from tidemark.operators import order

    written = []
    plain = order.materialise
    monkeypatch.setattr(order, "materialise", lambda df, label: written.append(df.columns) or plain(df, label))
    df = spark.createDataFrame([(2, 1, 5.0, "x"), (1, 2, 6.0, "y"), (1, 1, 7.0, "z")], "a int, b int, v double, s string")
    frame = Frame.of(df, ["v"], ["a", "b"])
    assert written == [["v", "_mid"]] and sorted((r.row_id, r.v) for r in frame.df.collect()) == [(0, 7.0), (1, 6.0), (2, 5.0)]
