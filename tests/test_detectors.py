"""Detector properties: one score in [0, 1] per row, and outliers stand out."""

import importlib
import inspect
import pkgutil

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import tidemark
from tidemark.detectors import nets, registry
from tidemark.detectors.base import Detector
from tidemark.frame import Frame

QUICK = {"autoencoder": {"epochs": 30}, "lstm_autoencoder": {"epochs": 3}, "transformer": {"epochs": 3}}


def make_frame(spark, x):
    cols = [f"f{i}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=cols)
    pdf.insert(0, "row_id", np.arange(len(x)))
    return Frame(spark.createDataFrame(pdf).repartition(4), tuple(cols), len(x))


def scores_of(detector, frame):
    pdf = detector.fit_predict(frame).toPandas().sort_values("row_id")
    assert pdf["row_id"].tolist() == list(range(frame.n))
    return pdf["score"].to_numpy()


@pytest.fixture(scope="module")
def shifted():
    rng = np.random.default_rng(42)
    return np.vstack([rng.normal(0, 1, (180, 4)), rng.normal(6, 0.5, (12, 4))])


@pytest.mark.parametrize("name", ["isolation_forest", "pca", "one_class_svm", "local_outlier_factor", "dbscan",
                                  "gaussian_mixture", "autoencoder", "lstm_autoencoder", "transformer",
                                  "prophet", "arima", "seasonal_decompose"])
def test_scores_are_in_range(spark, shifted, name):
    s = scores_of(registry.create(name, **QUICK.get(name, {})), make_frame(spark, shifted))
    assert np.isfinite(s).all() and s.min() >= 0 and s.max() <= 1


@pytest.mark.parametrize("name, options", [
    ("isolation_forest", {}), ("one_class_svm", {}), ("one_class_svm", {"kernel": "linear"}),
    ("local_outlier_factor", {"n_neighbors": 30}), ("dbscan", {"eps": 0.25, "min_samples": 13}),
])
def test_outliers_score_higher(spark, shifted, name, options):
    s = scores_of(registry.create(name, **options), make_frame(spark, shifted))
    if options.get("kernel") == "linear":
        s = 1 - s  # with a linear kernel, rows near the origin are the unusual ones
    assert s[180:].mean() > s[:180].mean()


def test_forest_does_not_depend_on_partitions(spark, shifted):
    f = make_frame(spark, shifted)
    one = scores_of(registry.create("isolation_forest"), f.with_df(f.df.coalesce(1)))
    many = scores_of(registry.create("isolation_forest"), f.with_df(f.df.repartition(16)))
    assert np.allclose(one, many)


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    lrd = 1 / (np.maximum(dist[:, -1][near], dist).mean(1) + 1e-10)
    return lrd[near].mean(1) / lrd


def test_lof_with_copies_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    x[:4] = x[0]
    x[40:43] = x[40]
    got = registry.create("local_outlier_factor", n_neighbors=7).raw_scores(make_frame(spark, x)).toPandas()
    assert np.allclose(got.sort_values("row_id")["raw"], brute_lof(x, 7), rtol=1e-6)


def brute_dbscan(x, eps, need):
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = (d <= eps).sum(1) >= need
    gap = d[:, core].min(1) if core.any() else np.ones(len(x))
    noise = ~core & (gap > eps)
    return np.where(noise, gap / gap[noise].max() if noise.any() else 0, 0.0), core


@pytest.mark.parametrize("eps, need", [(0.05, 4), (0.15, 6), (0.5, 5)])
def test_dbscan_against_brute_force(spark, eps, need):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (150, 2)), rng.uniform(-9, 9, (30, 2))])
    x[:60] = x[0]  # a third are copies
    want, _ = brute_dbscan(x, eps, need)
    assert np.allclose(scores_of(registry.create("dbscan", eps=eps, min_samples=need), make_frame(spark, x)), want)


def test_dbscan_without_cores(spark):
    x = np.arange(12.0).reshape(6, 2)
    assert (scores_of(registry.create("dbscan", eps=0.01, min_samples=3), make_frame(spark, x)) == 1).all()


def test_dbscan_clusters(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 0.2, (40, 2)), rng.normal(5, 0.2, (40, 2)), [[2.5, 2.5]]])
    labels = registry.create("dbscan", eps=0.1, min_samples=4).labels(make_frame(spark, x)).toPandas()
    labels = labels.sort_values("row_id")["cluster"].to_numpy()
    assert len(set(labels[:40])) == 1 and len(set(labels[40:80])) == 1
    assert labels[0] != labels[40] and labels[80] == -1


def test_tiny_inputs(spark):
    one = make_frame(spark, np.ones((1, 3)))
    for name in ("isolation_forest", "pca", "local_outlier_factor"):
        assert scores_of(registry.create(name), one).tolist() == [0.0]
    empty = Frame(spark.createDataFrame([], "row_id bigint, f0 double"), ("f0",), 0)
    assert registry.create("pca").fit_predict(empty).count() == 0


def test_arima_recovers_coefficients(spark):
    rng = np.random.default_rng(6)
    e = rng.normal(size=6000)
    w = np.zeros(6000)
    for t in range(1, 6000):
        w[t] = 0.6 * w[t - 1] + e[t] + 0.4 * e[t - 1]
    w[3000] += 40  # a spike must not bend the fit
    f = make_frame(spark, w[:, None])
    arima = registry.create("arima", order=(1, 0, 1))
    df = f.df.select("row_id", F.col("f0").alias("w"), F.greatest(F.least("f0", F.lit(6.0)), F.lit(-6.0)).alias("c"))
    _, phi, theta = arima._fit(df, f.n, 1, 1, True)
    assert abs(phi[0] - 0.6) < 0.06 and abs(theta[0] - 0.4) < 0.08
    raw = arima.raw_scores(f).toPandas().sort_values("row_id")["raw"].to_numpy()
    assert raw.argmax() == 3000


def test_prophet_follows_trend_and_season(spark):
    t = np.arange(1500)
    y = 0.02 * t + 5 * np.sin(2 * np.pi * t / 24) + np.random.default_rng(7).normal(0, 0.3, 1500)
    y[700] += 12
    raw = registry.create("prophet").raw_scores(make_frame(spark, y[:, None])).toPandas().sort_values("row_id")["raw"]
    assert raw.to_numpy().argmax() == 700
    assert raw.median() < 1.0


@pytest.mark.parametrize("net, shape", [
    (nets.DenseNet(3, [4, 2], 0.0), (5, 3)), (nets.LstmNet(2, 4, 3), (3, 4, 2)), (nets.AttentionNet(2, 4, 4, 2), (3, 4, 2)),
])
def test_gradients_against_differences(net, shape):
    rng = np.random.default_rng(8)
    x = rng.normal(size=shape)
    params = [p + 0.1 * rng.normal(size=p.shape) for p in net.init(rng)]

    def loss(ps):
        return float(((net.forward([nets.Tensor(p) for p in ps], x).data - x) ** 2).mean())

    leaves = [nets.Tensor(p) for p in params]
    gap = net.forward(leaves, x) - x
    (gap * gap).mean().backward()
    for i, p in enumerate(params):
        at = tuple(rng.integers(0, s) for s in p.shape)
        up, down = [q.copy() for q in params], [q.copy() for q in params]
        up[i][at] += 1e-6
        down[i][at] -= 1e-6
        grad = leaves[i].grad[at] if leaves[i].grad is not None else 0.0
        assert abs(grad - (loss(up) - loss(down)) / 2e-6) < 1e-5


def test_autoencoder_learns(spark):
    rng = np.random.default_rng(9)
    z = rng.normal(size=(600, 2))
    x = np.hstack([z, z @ rng.normal(size=(2, 4))])
    x[::60] = rng.normal(size=(10, 6)) * 2.5  # break the dependence
    auto = registry.create("autoencoder", encoding_dim=(16, 2), epochs=40, dropout=0.0, learning_rate=0.01)
    s = scores_of(auto, make_frame(spark, x))
    assert s[::60].mean() > np.delete(s, np.arange(0, 600, 60)).mean()


def test_custom_detector(spark):
    class Range(Detector):
        name = "range"
        defaults = {"power": 1}

        def raw_scores(self, frame):
            return frame.df.select("row_id", F.abs(frame.features[0]).alias("raw"))

    registry.register_detector("range", "custom", registry.Requirements(1), Range)
    try:
        d = registry.create("range", power=2)
        assert scores_of(d, make_frame(spark, np.array([[1.0], [-3.0], [2.0]]))).tolist() == [0.0, 1.0, 0.5]
        assert d.describe() == {"name": "range", "options": {"power": 2}, "fitted": True}
        assert registry.by_category()["custom"] == ["range"]
    finally:
        registry._REGISTRY.pop("range")
    with pytest.raises(TypeError):
        registry.register_detector("bad", "custom", registry.Requirements(1), dict)
    with pytest.raises(ValueError):
        registry.create("range")
    with pytest.raises(ValueError):
        registry.create("pca", depth=3)


def test_everything_travels_to_tasks():
    """Classes and functions of the package are sent by value, so nothing they name may refuse to be pickled."""
    for module in pkgutil.walk_packages(tidemark.__path__, "tidemark."):
        loaded = importlib.import_module(module.name)
        for thing in vars(loaded).values():
            if getattr(thing, "__module__", None) == module.name and (inspect.isclass(thing) or inspect.isfunction(thing)):
                cloudpickle.dumps(thing)


def test_user_detector_computes_in_tasks(spark, tmp_path):
    """A detector defined in a script, whose function for tasks holds on to the detector itself."""
    script = tmp_path / "own.py"
    script.write_text(
        "import pandas as pd\nfrom pyspark.sql import functions as F\nfrom tidemark.detectors.base import Detector\n"
        "class Mine(Detector):\n    name, defaults = 'mine', {'centre': 1.0}\n    def raw_scores(self, frame):\n"
        "        @F.pandas_udf('double')\n        def away(x: pd.Series) -> pd.Series:\n            return (x - self.options['centre']).abs()\n"
        "        return frame.df.select('row_id', away(F.col('x')).alias('raw'))\n"
    )
    space = {"__name__": "__main__"}
    exec(compile(script.read_text(), str(script), "exec"), space)
    frame = Frame(spark.createDataFrame([(i, float(i)) for i in range(9)], "row_id long, x double"), ("x",), 9)
    registry.register_detector("mine", "statistical", registry.Requirements(1), space["Mine"])
    try:
        got = {row["row_id"]: row["score"] for row in registry.create("mine", centre=0.0).fit_predict(frame).collect()}
    finally:
        registry.unregister_detector("mine")
    assert got == {i: i / 8 for i in range(9)}


def test_cells_link_as_all_pairs_do(spark):
    """Crowded layers just within, at and beyond the radius; single bridges between cells of different components."""
    from tidemark.operators.cells import linked_cells, touch

    rng = np.random.default_rng(8)
    radius = 0.25
    layers = [np.column_stack([rng.uniform(0, 1, (300, 2)), np.full(300, z)]) for z in (0.0, 0.25, 0.6, 0.849, 1.2)]
    x = np.vstack([*layers, rng.uniform(1.5, 4, (200, 3))])
    x[300] = x[0] + [0, 0, 0.25]  # the only link between the first two layers
    side = radius / np.sqrt(3) * (1 - 1e-9)
    _, cell = np.unique(np.floor(x / side), axis=0, return_inverse=True)
    node = np.array([np.flatnonzero(cell == c)[0] for c in range(cell.max() + 1)])[cell.ravel()]
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= radius
    root = np.arange(len(x))
    while True:
        least = np.where(near, root[None, :], len(x)).min(1)
        if (least == root).all():
            break
        root = least
    df = spark.createDataFrame([(i, row.tolist(), int(n)) for i, (row, n) in enumerate(zip(x, node))], "pid bigint, v array<double>, node bigint")
    got = {r["node"]: r["root"] for r in linked_cells(df, len(x), radius).collect()}
    assert [got[n] for n in node] == root.tolist()
    for a, b in ((layers[0], layers[1]), (layers[2], layers[3]), (layers[1], layers[2])):
        assert touch(a, b, radius) == bool((np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)) <= radius).any())


@pytest.mark.parametrize("net, shape", [
    (nets.DenseNet(3, [4, 2], 0.3), (9, 3)), (nets.LstmNet(2, 4, 3), (7, 4, 2)), (nets.AttentionNet(2, 4, 8, 2), (7, 4, 2)),
])
def test_written_out_gradients_equal_the_tape(net, shape):
    rng = np.random.default_rng(8)
    x = rng.normal(size=shape)
    params = [p + 0.1 * rng.normal(size=p.shape) for p in net.init(rng)]
    for drop in (None, 5):
        leaves = [nets.Tensor(p) for p in params]
        gap = net.forward(leaves, x, drop and np.random.default_rng(drop)) - x
        want = (gap * gap).mean()
        want.backward()
        loss, grads = net.gradient(params, x, drop and np.random.default_rng(drop))
        assert loss == pytest.approx(float(want.data.ravel()[0]), rel=1e-12)
        for leaf, grad in zip(leaves, grads):
            assert np.allclose(leaf.grad, grad, rtol=1e-9, atol=1e-12)
    assert np.allclose(net.predict(params, x), net.forward([nets.Tensor(p) for p in params], x).data, rtol=1e-12)
    small = [p.astype(np.float32) for p in params]
    assert all(g.dtype == np.float32 for g in net.gradient(small, x.astype(np.float32))[1])


def test_mixture_rounds_equal_sparks(spark):
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    from tidemark.detectors.statistical import expectation_maximisation, packed_rows

    rng = np.random.default_rng(10)
    x = np.vstack([rng.normal(0, 1, (300, 2)), rng.normal(4, 0.5, (200, 2))])
    data = spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>").coalesce(2).cache()
    rows = data.select(array_to_vector("v").alias("features"))
    for rounds in (1, 7, 100):
        want = GaussianMixture(k=2, seed=42, maxIter=rounds).fit(rows)
        start = GaussianMixture(k=2, seed=42, maxIter=0).fit(rows)
        held = start.gaussiansDF.collect()
        weights, means, covs = expectation_maximisation(
            packed_rows(data), np.array(start.weights), np.stack([r["mean"].toArray() for r in held]), np.stack([r["cov"].toArray() for r in held]), rounds
        )
        assert np.allclose(weights, want.weights, rtol=1e-9)
        for mean, cov, r in zip(means, covs, want.gaussiansDF.collect()):
            assert np.allclose(mean, r["mean"].toArray(), rtol=1e-9) and np.allclose(cov, r["cov"].toArray(), rtol=1e-8, atol=1e-12)


def test_sums_of_parted_rows():
    from tidemark.detectors.statistical import _parted

    z, w = np.random.default_rng(11).normal(size=(40, 3)), np.array([1.0, -2.0, 0.5])
    m = z @ w
    got = _parted(z, w, -0.5, 0.7)
    inside = (m >= -0.5) & (m < 0.7)
    assert np.allclose(got, [*z[m < -0.5].sum(0), *z[inside].sum(0), (m < -0.5).sum(), inside.sum()])


def test_autoencoder_deals_the_rows_to_learn_evenly(spark, monkeypatch):
    from tidemark.detectors import neural
    from tidemark.session import parallelism

    n, workers, counts = 80_000, parallelism(spark), []
    df = spark.range(0, n, 1, workers).select(F.col("id").alias("row_id"), F.sin("id").alias("a"), F.cos("id").alias("b"))
    frame = Frame(df, ("a", "b"), n)

    def count(data, samples, net, first_val, options):
        def run(batches):
            yield pd.DataFrame({"rows": [sum(int((at < first_val).sum()) for batch in batches for at, _ in samples(batch))]})

        counts.extend(r["rows"] for r in data.coalesce(workers).mapInPandas(run, "rows bigint").collect())
        return [np.zeros(p.shape, np.float32) for p in net.init(np.random.default_rng(0))]

    monkeypatch.setattr(neural, "train", count)
    raw = registry.create("autoencoder").raw_scores(frame).toPandas().sort_values("row_id")
    # the last fifth is held out: left where it lies, it makes the others learn a quarter more
    assert sum(counts) == 0.8 * n and max(counts) < 1.15 * 0.8 * n / workers
    # a network of zeros gives zeros, so the error is the mean square of the row itself
    x = df.toPandas().sort_values("row_id")[["a", "b"]].to_numpy()
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    assert raw["row_id"].tolist() == list(range(n)) and np.allclose(raw["raw"], (x * x).mean(1), rtol=1e-5, atol=1e-7)


def test_steps_that_use_arrays_again_equal_the_textbook():
    net, drop, sizes = nets.DenseNet(3, [8, 4], 0.25), np.random.default_rng(12), (16, 16, 5, 16, 5)
    rng = np.random.default_rng(13)
    local = net.init(rng)
    want, m, v = [p.copy() for p in local], 0.0, 0.0
    adam, same = nets.Adam(local, 0.01), np.random.default_rng(12)
    for t, rows in enumerate(sizes, 1):
        x = rng.normal(size=(rows, 3))
        leaves = [nets.Tensor(p) for p in want]
        gap = net.forward(leaves, x, same) - x
        loss = (gap * gap).mean()
        loss.backward()
        assert adam.step(net, local, x, drop) == pytest.approx(float(loss.data.ravel()[0]), rel=1e-12)
        grad = nets.flatten([leaf.grad for leaf in leaves])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
        want = nets.unflatten(nets.flatten(want) - move, want)
    assert all(np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in zip(local, want))
    kept = net._kept(np.random.default_rng(14), (1000, 1000))
    assert abs(kept.mean() - 0.75) < 0.002
