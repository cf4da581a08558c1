"""Data characteristics and the rules that choose detectors from them."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.detectors import registry
from tidemark.frame import Frame
from tidemark.operators.linalg import components_for, covariance
from tidemark.operators.order import over_blocks
from tidemark.operators.quantile import quantiles
from tidemark.operators.sampling import md5_sample

METHODS = ("metaod", "fmms", "orthus")

# fixed values: thresholds and preferences of the selection rules
METAOD_RULES = (
    ("dimensionality_ratio", 0.1, ("pca", "autoencoder")),
    ("n_samples", 10_000, ("isolation_forest", "local_outlier_factor")),
    ("outlier_fraction", 0.15, ("dbscan", "one_class_svm")),
    ("series_like", 0.0, ("lstm_autoencoder", "prophet")),
)
ORTHUS_GROUPS = {
    "statistical": ("isolation_forest", "pca", "one_class_svm", "local_outlier_factor"),
    "clustering": ("dbscan", "gaussian_mixture"),
    "deep_learning": ("autoencoder", "lstm_autoencoder", "transformer"),
    "time_series": ("prophet", "arima", "seasonal_decompose"),
}
# base score, meta-feature, its threshold, bonus above it
RANKING = {
    "isolation_forest": (3, None, 0, 0),
    "pca": (2, "dimensionality_ratio", 0.1, 1),
    "local_outlier_factor": (2, "clustering_tendency", 0.5, 1),
    "autoencoder": (1, "n_samples", 1000, 2),
    "lstm_autoencoder": (1, "series_like", 0.0, 2),
    "transformer": (1, "series_like", 0.0, 2),
}
FALLBACK = ("isolation_forest", "pca", "local_outlier_factor")
FAST_AT_SCALE = ("isolation_forest", "local_outlier_factor", "pca")
ROBUST = ("isolation_forest", "pca", "one_class_svm")
FMMS_KEPT = 3
FOREST_TREES, HOPKINS_PROBES = 50, 200
PROBED_ROWS = 256  # rows compared with all probes at once: two tables that stay in the processor's cache
DEFAULT_OUTLIERS = 0.1


# ---------------------------------------------------------------- meta-features


def shape_features(frame: Frame) -> dict[str, float]:
    d = len(frame.features)
    return {
        "n_samples": float(frame.n),
        "n_features": float(d),
        "dimensionality_ratio": d / frame.n if frame.n else 0.0,
    }


def moment_features(frame: Frame) -> dict[str, float]:
    """Mean absolute skewness and mean excess kurtosis over columns."""
    row = frame.df.agg(
        *[F.coalesce(F.skewness(c), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(frame.features)],
        *[F.coalesce(F.kurtosis(c), F.lit(0.0)).alias(f"k{i}") for i, c in enumerate(frame.features)],
    ).first()
    d = len(frame.features)
    return {
        "skewness": float(np.mean([abs(row[f"s{i}"]) for i in range(d)])),
        "kurtosis": float(np.mean([row[f"k{i}"] for i in range(d)])),
    }


def covariance_features(frame: Frame) -> dict[str, float]:
    """Mean absolute correlation, and the share of components reaching 95 % of the variance."""
    d = len(frame.features)
    _, cov, _ = covariance(frame.df, frame.features)
    sd = np.sqrt(np.diag(cov))
    known = np.outer(sd, sd)[np.triu_indices(d, 1)]
    pairs = cov[np.triu_indices(d, 1)]
    usable = known > 0
    correlation = float(np.mean(np.abs(pairs[usable] / known[usable]))) if usable.any() else 0.0
    values = np.clip(np.linalg.eigvalsh(cov)[::-1], 0.0, None)
    total = values.sum()
    # the last digit of a cumulative ratio must not decide whether it reaches the bound
    k = components_for(values / total + 1e-15, 0.95, inclusive=True) if total > 0 else 1
    return {"mean_correlation": correlation, "intrinsic_dimensionality": k / d}


def outlier_fraction(frame: Frame) -> float:
    q = quantiles(frame.df, frame.features, [0.25, 0.75])
    fences = {c: (a - 1.5 * (b - a), b + 1.5 * (b - a)) for c, (a, b) in q.items() if b - a > 0}
    if not fences:
        return DEFAULT_OUTLIERS
    row = frame.df.agg(
        *[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"o{i}") for i, (c, (lo, hi)) in enumerate(fences.items())]
    ).first()
    return float(np.mean(list(row))) / frame.n


def order_features(frame: Frame) -> dict[str, float]:
    """Noise level, signal-to-noise ratio, and the lag-1 correlation test of the first column."""
    first = frame.features[0]
    diffs = over_blocks(
        frame.df,
        frame.n,
        {f"_prev{i}": (lambda w, c=c: F.lag(F.col(c).cast("double"), 1).over(w)) for i, c in enumerate(frame.features)},
        1,
    )
    row = diffs.agg(
        *[F.stddev_pop(F.col(c) - F.col(f"_prev{i}")).alias(f"n{i}") for i, c in enumerate(frame.features)],
        *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(frame.features)],
        F.when(
            (F.stddev_pop(F.when(F.col("_prev0").isNotNull(), F.col(first))) > 0) & (F.stddev_pop("_prev0") > 0),
            F.corr(first, "_prev0"),
        ).alias("r"),
    ).first()
    d = len(frame.features)
    noise = float(np.mean([row[f"n{i}"] or 0.0 for i in range(d)])) if frame.n > 1 else 0.0
    power = float(np.mean([row[f"v{i}"] or 0.0 for i in range(d)]))
    return {
        "noise_level": noise,
        "signal_to_noise_ratio": power / noise**2 if noise > 0 else math.inf,
        "lag_correlation": row["r"] if row["r"] is not None else 0.0,
        "series_like": float(is_series_like(row["r"], frame.n)),
    }


def is_series_like(r: float | None, n: int) -> bool:
    """|r| above 0.3 and significant at 5 % (two-sided t test on n - 1 pairs)."""
    if n < 10 or r is None or abs(r) <= 0.3:
        return False
    freedom = n - 3
    t2 = r * r * freedom / max(1 - r * r, 1e-300)
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t2)) < 0.05


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (two-sided t tail)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / max(1 + num * d, 1e-300)
            c = max(1 + num / c, 1e-300)
            h *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * h / a


def isolation_spread(frame: Frame) -> float:
    """Deviation of the forest's raw scores over all rows."""
    forest = registry.create("isolation_forest", n_estimators=FOREST_TREES)
    return float(forest.raw_scores(frame).agg(F.stddev_pop("raw")).first()[0] or 0.0)


def hopkins(frame: Frame, seed: int = 42, probes: int = HOPKINS_PROBES) -> float:
    """Clustering tendency (0.5 = uniform): distances from ``probes`` rows and as many random points to the nearest row.

    The probes are the only sample, and of fixed number; every row of the table is compared with them.
    """
    features = list(frame.features)
    own = md5_sample(frame.df, "row_id", probes, frame.n, str(seed)).select("row_id", *features).toPandas()
    if len(own) < 2:
        return 0.5
    x = own[features].to_numpy(dtype=float)
    share = np.array([
        [int(hashlib.md5(f"{seed}|{i}|{row}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(len(features))] for row in own["row_id"]
    ])
    points = np.concatenate([x, x.min(0) + (x.max(0) - x.min(0)) * share])
    rows = np.concatenate([own["row_id"].to_numpy(), np.full(len(own), -1)])

    def nearest(batches):
        best = np.full(len(points), np.inf)
        gap, square = (np.empty((len(points), PROBED_ROWS)) for _ in range(2))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            values = [c.cast("double").to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            for k in range(0, len(ids), PROBED_ROWS):
                part = slice(k, k + PROBED_ROWS)
                width = len(ids[part])
                g, total = gap[:, :width], square[:, :width]
                total[:] = 0.0
                for i, v in enumerate(values):
                    np.subtract(points[:, i, None], v[None, part], out=g)
                    np.multiply(g, g, out=g)
                    np.add(total, g, out=total)
                for at in np.flatnonzero(np.isin(ids[part], rows)):
                    total[rows == ids[k + at], at] = np.inf
                best = np.minimum(best, total.min(1))
        yield pa.RecordBatch.from_pydict({"point": pa.array(np.arange(len(points), dtype=np.int32)), "square": pa.array(best)})

    found = frame.df.select("row_id", *features).mapInArrow(nearest, "point int, square double")
    least = found.groupBy("point").agg(F.min("square").alias("square")).orderBy("point").toPandas()["square"].to_numpy()
    w, u = np.sqrt(least[: len(own)]).sum(), np.sqrt(least[len(own):]).sum()
    return float(u / (w + u)) if w + u > 0 else 0.5


def meta_features(frame: Frame) -> dict[str, float]:
    return {
        **shape_features(frame),
        **covariance_features(frame),
        **moment_features(frame),
        **order_features(frame),
        "outlier_fraction": outlier_fraction(frame),
        "isolation_score": isolation_spread(frame),
        "clustering_tendency": hopkins(frame),
    }


# ---------------------------------------------------------------- rules


def metaod(meta: dict[str, float], available: list[str]) -> list[str]:
    chosen = [
        m for key, limit, models in METAOD_RULES if meta[key] > limit for m in models if m in available
    ]
    return chosen or available[:1]


def orthus(meta: dict[str, float], available: list[str]) -> list[str]:
    """One model per group, so that the choice is diverse."""
    series = meta["series_like"] > 0
    preferred = {
        "statistical": ("isolation_forest", "pca"),
        "clustering": ("gaussian_mixture",) if meta["clustering_tendency"] > 0.5 else ("dbscan",),
        "deep_learning": (),
        "time_series": ("prophet",),
    }
    if meta["n_samples"] > 1000:
        preferred["deep_learning"] = ("lstm_autoencoder", "autoencoder") if series else ("autoencoder",)
    chosen = []
    for group, members in ORTHUS_GROUPS.items():
        present = [m for m in members if m in available]
        if present and (group != "time_series" or series):
            wanted = [m for m in preferred[group] if m in present]
            chosen.append((wanted or present)[0])
    return chosen


def fmms_table(frame: Frame, available: list[str]) -> DataFrame:
    """model, quality, error: variance times range of each candidate's scores, or why it could not run."""
    rows = []
    for name in available:
        try:
            scores = registry.create(name).fit_predict(frame)
            v, span = scores.agg(F.var_pop("score"), F.max("score") - F.min("score")).first()
            rows.append((name, float(v) * float(span), None))
        except Exception as e:  # noqa: BLE001 - stated in the table; the other candidates still run
            rows.append((name, None, f"{type(e).__name__}: {e}"))
    return frame.df.sparkSession.createDataFrame(rows, "model string, quality double, error string")


def fmms(frame: Frame, available: list[str]) -> list[str]:
    table = fmms_table(frame, available)
    found = {r["model"]: r["quality"] for r in table.where("error is null").collect()}  # at most a row per model
    return sorted(found, key=lambda m: (-found[m], available.index(m)))[:FMMS_KEPT]


def rank(models: list[str], meta: dict[str, float]) -> list[str]:
    """Best first; ties keep registry order."""
    order = registry.names()

    def score(m: str) -> float:
        base, key, limit, bonus = RANKING.get(m, (1, None, 0, 0))
        return base + (bonus if key and meta[key] > limit else 0)

    return sorted(models, key=lambda m: (-score(m), order.index(m)))


def select_models(
    frame: Frame,
    available: list[str] | None = None,
    methods=METHODS,
    min_models: int = 2,
    max_models: int = 5,
    enabled: bool = True,
    meta: dict[str, float] | None = None,
) -> list[str]:
    """Union of the methods, filled up to ``min_models`` and cut to the best ``max_models``."""
    available = available or registry.names()
    if not enabled:
        return list(available)
    meta = meta or meta_features(frame)
    chosen: set[str] = set()
    for method in methods:
        if method == "metaod":
            chosen |= set(metaod(meta, available))
        elif method == "orthus":
            chosen |= set(orthus(meta, available))
        elif method == "fmms":
            chosen |= set(fmms(frame, available))
        else:
            raise ValueError(f"unknown selection method {method}; expected {METHODS}")
    return fit_bounds(chosen, available, meta, min_models, max_models)


def fit_bounds(chosen, available, meta, min_models: int = 2, max_models: int = 5) -> list[str]:
    order = registry.names()
    final = sorted(chosen, key=order.index)
    for m in FALLBACK:
        if len(final) >= min_models:
            break
        if m in available and m not in final:
            final.append(m)
    return rank(final, meta)[:max_models] if len(final) > max_models else final


def compatible(spark, meta: dict[str, float]) -> DataFrame:
    """Registry rows whose requirements the data meets."""
    return registry.registry_table(spark).where(
        (F.col("min_samples") <= F.lit(meta["n_samples"]))
        & (F.col("supports_multivariate") | F.lit(meta["n_features"] <= 1))
    )


def recommend(spark, meta: dict[str, float], top: int = 5) -> DataFrame:
    """Compatible models by suitability, ties in registry order: model, suitability."""
    n, d = meta["n_samples"], meta["n_features"]
    one = lambda test, worth: F.when(test, F.lit(worth)).otherwise(F.lit(0))
    suitability = (
        one(F.lit(n > 10_000) & F.col("memory_efficient"), 2)
        + one(F.lit(d > 10) & F.col("supports_multivariate"), 2)
        + one(F.lit(n > 50_000) & F.col("model").isin(*FAST_AT_SCALE), 1)
        + one(F.col("model").isin(*ROBUST), 1)
    )
    return (
        compatible(spark, meta)
        .withColumn("suitability", suitability)
        .orderBy(F.desc("suitability"), "position")
        .limit(top)
        .select("position", "model", "suitability")
    )


def selection_summary(chosen: list[str], meta: dict[str, float], methods=METHODS, min_models=2, max_models=5) -> dict:
    return {
        "enabled": True, "methods_used": list(methods), "selected": list(chosen),
        "constraints": {"min_models": min_models, "max_models": max_models}, "meta_features": dict(meta),
    }
