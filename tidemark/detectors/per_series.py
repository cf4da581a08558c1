"""Detectors with a model of its own for every series, as one plan for any number of series.

A fit is an aggregate keyed by the series, its result a table with a row per series, which joins the rows of the
series again.  Sums of products come from blocks of neighbouring rows: a block holds many short series or a part of
a long one, so tasks are alike however the series are distributed, and a series costs a matrix per block it touches.
The matrices are solved where they are summed, a series at a time.

``raw_scores_by(segments, features, model, options)`` gives _g, row_id, raw for the models in ``MODELS``; the
others grow trees, iterate over the data or compare all rows and have no form that is one aggregate per series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.detectors.temporal import Arima, Prophet
from tidemark.functions.scalars import row_mean
from tidemark.operators.linalg import principal
from tidemark.operators.order import block_rows, running_totals
from tidemark.operators.quantile import quantiles_by
from tidemark.operators.recursion import filtered
from tidemark.operators.scale import scale_by
from tidemark.operators.segments import Segments, lags_within
from tidemark.operators.series import moving_sum
from tidemark.operators.skew import join_series
from tidemark.session import materialise, shuffle_partitions

_CELLS = "_g bigint, i int, j int, value double, rows bigint"


def products_by(df: DataFrame, total: int, inputs: Sequence[str], design: Callable[..., np.ndarray]) -> DataFrame:
    """_g, cells (array of i, j, value), rows: the sum of v v' over the rows of each series.

    ``design`` turns arrays of the inputs into one vector v per row.  Rows with a missing input are left out.
    """
    spark = df.sparkSession
    block = F.floor(F.col("_pos") / min(block_rows(spark, total, 0), 8192))
    slim = df.select("_g", "_pos", *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(inputs)])
    placed = slim.repartition(shuffle_partitions(spark), block).sortWithinPartitions("_pos")

    def cells(group: int, m: np.ndarray, rows: int) -> pa.RecordBatch:
        i, j = np.triu_indices(len(m))
        columns = [np.full(len(i), group, np.int64), i.astype(np.int32), j.astype(np.int32), m[i, j], np.full(len(i), rows, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_g", "i", "j", "value", "rows"])

    def fold(batches):
        # positions ascend, so the rows of a series come one after the other
        now, m, n = None, None, 0
        for batch in batches:
            group = batch.column(0).to_numpy()
            values = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(inputs))], axis=1)
            good = np.isfinite(values).all(axis=1)
            group, values = group[good], values[good]
            cut = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else []
            for a, b in zip(cut, [*cut[1:], len(group)]):
                v = design(*values[a:b].T)
                if group[a] != now:
                    if n:
                        yield cells(now, m, n)
                    now, m, n = group[a], 0.0, 0
                m, n = m + v.T @ v, n + b - a
        if n:
            yield cells(now, m, n)

    summed = placed.mapInArrow(fold, _CELLS).groupBy("_g", "i", "j").agg(F.sum("value").alias("value"), F.sum("rows").alias("rows"))
    return summed.groupBy("_g").agg(F.collect_list(F.struct("i", "j", "value")).alias("cells"), F.max("rows").alias("rows"))


def solved_by(products: DataFrame, function: Callable[[np.ndarray, int], np.ndarray], out: str) -> DataFrame:
    """_g and an array: the model of each series from its matrix of products and its number of rows."""

    def solve(batches):
        for batch in batches:
            models = []
            for cells, rows in zip(batch["cells"], batch["rows"]):
                d = 1 + max(c["i"] for c in cells)
                m = np.zeros((d, d))
                for c in cells:
                    m[c["i"], c["j"]] = m[c["j"], c["i"]] = c["value"]
                models.append(np.asarray(function(m, int(rows)), float).ravel())
            yield pd.DataFrame({"_g": batch["_g"], out: models})

    spark = products.sparkSession
    return materialise(products.repartition(shuffle_partitions(spark), "_g").mapInPandas(solve, f"_g bigint, {out} array<double>"), "series-models")


def _filled(raw: DataFrame, total: int) -> DataFrame:
    """Rows without a residual take the median of their series, or 0."""
    mid = quantiles_by(raw, ["_g"], "raw", {"_mid": 0.5})
    known = raw.select("_g").distinct().join(mid, "_g", "left")
    return join_series(raw, materialise(known, "middles"), ["_g"], total).withColumn("raw", F.coalesce("raw", "_mid", F.lit(0.0))).drop("_mid")


def _univariate(segments: Segments, features: Sequence[str]) -> DataFrame:
    return materialise(segments.df.select("_g", "_pos", "row_id", "_n", row_mean(list(features)).alias("y")), "series")


# ---------------------------------------------------------------- principal components


def pca_by(segments: Segments, features: Sequence[str], n_components: float | int = 0.95) -> DataFrame:
    """_g, mean, left_out: the flattened matrix that takes a centred row to what its components leave out."""
    d = len(features)
    mean = segments.df.groupBy("_g").agg(F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in features]).alias("mean"))
    mean = materialise(mean, "series-means")
    centred = join_series(segments.df.select("_g", "_pos", *features), mean, ["_g"], segments.total).withColumns(
        {c: F.col(c).cast("double") - F.col("mean")[i] for i, c in enumerate(features)}
    )

    def leave(m: np.ndarray, rows: int) -> np.ndarray:
        kept, _ = principal(m / max(rows - 1, 1), n_components)
        return np.eye(d) - kept.T @ kept

    model = solved_by(products_by(centred, segments.total, list(features), lambda *x: np.stack(x, axis=1)), leave, "left_out")
    return mean.join(model, "_g")


def _pca(segments: Segments, features: Sequence[str], options: dict) -> DataFrame:
    d = len(features)
    scaled = Segments(materialise(scale_by(segments.df, features, ["_g"], "minmax"), "scaled"), segments.groups, segments.by, segments.total)
    model = pca_by(scaled, features, options.get("n_components", 0.95))

    @F.pandas_udf("double")
    def residual(v: pd.Series, mean: pd.Series, left_out: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="float64")
        x = np.stack(v.to_numpy()) - np.stack(mean.to_numpy())
        left = np.einsum("ni,nij->nj", x, np.stack(left_out.to_numpy()).reshape(-1, d, d))
        return pd.Series((left**2).mean(axis=1))

    vector = F.array(*[F.col(c).cast("double") for c in features])
    return join_series(scaled.df, model, ["_g"], segments.total).select("_g", "row_id", residual(vector, "mean", "left_out").alias("raw"))


# ---------------------------------------------------------------- decomposition


def decompose_by(series: DataFrame, total: int, period: int, model: str = "additive") -> DataFrame:
    """_g, _pos, row_id, _n, y, trend, seasonal, resid; windows that leave the series give no trend."""
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unknown decomposition model {model}")
    if model == "multiplicative" and series.where("y <= 0").limit(1).count():
        raise ValueError("multiplicative decomposition needs positive values")
    half = period // 2
    # a full window lies inside its series, so windows may be taken over all series laid one behind the other
    laid = series.select("_g", "_n", "y", F.col("row_id").alias("_at"), F.col("_pos").alias("row_id"))
    if period % 2:
        out = moving_sum(laid, total, half, half).withColumn("trend", F.col("_sum") / F.lit(float(period)))
    else:
        out = moving_sum(moving_sum(laid, total, half, half - 1, out="_left"), total, half - 1, half)
        out = out.withColumn("trend", (F.col("_left") + F.col("_sum")) / F.lit(2.0 * period)).drop("_left")
    whole = (F.col("_at") >= half) & (F.col("_at") < F.col("_n") - half)
    out = out.drop("_sum").withColumn("trend", F.when(whole, F.col("trend")))
    detrended = F.col("y") - F.col("trend") if model == "additive" else F.col("y") / F.col("trend")
    out = materialise(out.withColumns({"detrended": detrended, "phase": F.pmod("_at", F.lit(period)).cast("int")}), "trend")
    phases = out.groupBy("_g", "phase").agg(F.avg("detrended").alias("seasonal"))
    centre = phases.groupBy("_g").agg(F.avg("seasonal").alias("_centre"))
    level = F.col("seasonal") - F.col("_centre") if model == "additive" else F.col("seasonal") / F.col("_centre")
    phases = materialise(phases.join(centre, "_g").select("_g", "phase", level.alias("seasonal")), "phases")
    placed = join_series(out, phases, ["_g", "phase"], total)
    resid = F.col("detrended") - F.col("seasonal") if model == "additive" else F.col("detrended") / F.col("seasonal")
    return placed.select("_g", F.col("row_id").alias("_pos"), F.col("_at").alias("row_id"), "_n", "y", "trend", "seasonal", resid.alias("resid"))


def moving_average_residual_by(series: DataFrame, total: int) -> DataFrame:
    """|y - centred average| over a twentieth of each series, ends filled with the nearest full window."""
    window = F.greatest(F.lit(2), F.floor(F.col("_n") / 20)).cast("bigint")
    before, after = F.floor(window / 2), F.floor((window - 1) / 2)
    means = series.groupBy("_g").agg(F.avg("y").alias("_mean"))
    centred = join_series(series, means, ["_g"], total).withColumn("_c", F.coalesce(F.col("y") - F.col("_mean"), F.lit(0.0)))
    sums = materialise(running_totals(centred, total, {"_upto": "_c"}, pos="_pos"), "totals")
    # of a row at the ends the nearest row with a full window answers
    centre = F.greatest(F.least(F.col("row_id"), F.col("_n") - after - 1), before)
    asked = sums.select("_g", "_pos", "row_id", "y", "_mean", window.alias("_w"), (F.col("_pos") - F.col("row_id") + centre).alias("_c_at"), before.alias("_b"), after.alias("_a"), "_n")
    high = sums.select((F.col("_pos")).alias("_high_at"), F.col("_upto").alias("_high"))
    low = sums.select((F.col("_pos") + 1).alias("_low_at"), F.col("_upto").alias("_low"))
    held = asked.join(high, F.col("_high_at") == F.col("_c_at") + F.col("_a"), "left").join(low, F.col("_low_at") == F.col("_c_at") - F.col("_b"), "left")
    average = (F.col("_high") - F.coalesce("_low", F.lit(0.0))) / F.col("_w") + F.col("_mean")
    fits = F.col("_n") >= F.col("_w")
    return held.select("_g", "row_id", F.when(fits, F.abs(F.col("y") - average)).alias("raw"))


def _seasonal(segments: Segments, features: Sequence[str], options: dict) -> DataFrame:
    period = options.get("period")
    if not period:
        raise ValueError("seasonal_decompose per series needs its period")
    series = _univariate(segments, features)
    enough = F.col("_n") >= 2 * period
    # windows count positions, so all series stay in place and each takes the residual of its kind
    seasonal = decompose_by(series, segments.total, period, options.get("model", "additive")).where(enough)
    long = _filled(seasonal.select("_g", "row_id", F.abs("resid").alias("raw")), segments.total)
    short = moving_average_residual_by(series, segments.total).join(segments.groups.where(~enough).select("_g"), "_g", "left_semi")
    return long.unionByName(short)


# ---------------------------------------------------------------- forecasts


def _prophet_design(row_id: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The columns of ``Prophet``; series too short for all changepoints have columns of zeros in their place."""
    t = row_id / np.maximum(n - 1, 1)
    hinges = np.maximum(0, np.minimum(Prophet.CHANGEPOINTS, np.floor(n * Prophet.CHANGE_RANGE) - 1))
    cols = [np.ones_like(t), t]
    for k in range(1, Prophet.CHANGEPOINTS + 1):
        at = np.where(k <= hinges, Prophet.CHANGE_RANGE * k / np.maximum(hinges, 1), np.inf)
        cols.append(np.maximum(t - at, 0.0))
    for period, order in Prophet.SEASONS:
        phase = np.mod(row_id, period) * (2 * np.pi / period)
        for k in range(1, order + 1):
            cols += [np.sin(phase * k), np.cos(phase * k)]
    return np.stack(cols, axis=1)


def _prophet(segments: Segments, features: Sequence[str], options: dict) -> DataFrame:
    detector = Prophet(**options)
    series = _univariate(segments, features)
    top = series.groupBy("_g").agg(F.coalesce(F.nullif(F.max(F.abs("y")), F.lit(0.0)), F.lit(1.0)).alias("_top"))
    scaled = materialise(join_series(series, top, ["_g"], segments.total).withColumn("_y", F.col("y") / F.col("_top")), "prophet")
    products = products_by(scaled, segments.total, ["row_id", "_n", "_y"], lambda row_id, n, y: np.column_stack([_prophet_design(row_id, n), y]))
    d = 2 + Prophet.CHANGEPOINTS + 2 * sum(order for _, order in Prophet.SEASONS)
    model = solved_by(products, lambda m, rows: detector._solve(m[:d, :d], m[:d, d], m[d, d], rows, Prophet.CHANGEPOINTS), "beta")

    @F.pandas_udf("double")
    def fitted(row_id: pd.Series, n: pd.Series, beta: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype="float64")
        return pd.Series((_prophet_design(row_id.to_numpy(float), n.to_numpy(float)) * np.stack(beta.to_numpy())).sum(axis=1))

    joined = join_series(scaled, model, ["_g"], segments.total)
    return joined.select("_g", "row_id", (F.abs(F.col("_y") - fitted("row_id", "_n", "beta")) * F.col("_top")).alias("raw"))


def _dot(names: Sequence[str], weights: Column) -> Column:
    return sum((F.col(c) * weights[i] for i, c in enumerate(names)), F.lit(0.0))


def _regression(with_const: bool) -> Callable[..., np.ndarray]:
    """Least squares of the last input on the others."""
    return lambda *x: np.column_stack([*([np.ones(len(x[0]))] if with_const else []), *x])


def _coefficients(m: np.ndarray, rows: int) -> np.ndarray:
    return np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]


def _arima(segments: Segments, features: Sequence[str], options: dict) -> DataFrame:
    detector = Arima(**options)
    (p, d, q), total = detector.options["order"], segments.total
    if detector.options["coefficients"] is not None:
        raise ValueError("coefficients are fitted per series")
    series = _univariate(segments, features).withColumn("w", F.col("y")).drop("y")
    for _ in range(d):
        series, _names = lags_within(series, total, [("w", 1)])
        series = series.withColumn("w", F.col("w") - F.col("w_1")).drop("w_1")
    series = materialise(series, "differences")
    mid = quantiles_by(series, ["_g"], "w", {"_mid": 0.5})
    known = series.select("_g").distinct()
    away = materialise(join_series(series, materialise(known.join(mid, "_g", "left"), "middles"), ["_g"], total).withColumn("_away", F.abs(F.col("w") - F.col("_mid"))), "away")
    spread = known.join(quantiles_by(away, ["_g"], "_away", {"_spread": 0.5}), "_g", "left")
    reach = 4 * 1.4826 * F.col("_spread")
    clipped = F.when(reach > 0, F.greatest(F.least(F.col("w"), F.col("_mid") + reach), F.col("_mid") - reach)).otherwise(F.col("w"))
    series = materialise(join_series(away, materialise(spread, "spreads"), ["_g"], total).withColumn("c", clipped).select("_g", "_pos", "row_id", "w", "c"), "clipped")
    const = d == 0

    def fit(table: DataFrame, names: list[str], finish, out: str) -> DataFrame:
        """Models of the series that have any; the rest of their rows stay without one."""
        held = table.select("_g", "_pos", *names, "c")
        model = solved_by(products_by(held, total, [*names, "c"], _regression(const)), finish, out)
        return materialise(join_series(table, known.join(model, "_g", "left"), ["_g"], total), "fitted")

    if q:
        lagged, names = lags_within(series, total, [("c", max(10, 2 * (p + q)))])
        long = fit(lagged, names, _coefficients, "_long")
        shock = F.col("c") - _dot(names, F.slice("_long", 1 + int(const), len(names))) - (F.col("_long")[0] if const else F.lit(0.0))
        series = materialise(long.select("_g", "_pos", "row_id", "w", "c", shock.alias("e")), "shocks")
    lagged, names = lags_within(series, total, [("c", p), *([("e", q)] if q else [])])

    def finish(m: np.ndarray, rows: int) -> np.ndarray:
        coef = _coefficients(m, rows)
        start = int(const)
        return np.concatenate([coef[:start] if const else [0.0], coef[start: start + p], Arima._invertible(coef[start + p:])])

    if names or const:
        fitted = fit(lagged, names, finish, "_coef").select("_g", "_pos", "row_id", "w", "_coef")
    else:
        fitted = lagged.select("_g", "_pos", "row_id", "w", F.array(F.lit(0.0)).alias("_coef"))
    held, before = lags_within(fitted, total, [("w", p)])
    base = F.col("w") - F.col("_coef")[0] - _dot(before, F.slice("_coef", 2, p))
    based = materialise(held.select("_g", "_pos", "row_id", "_coef", base.alias("base")), "arima-base")
    if q:
        theta = F.coalesce(F.slice("_coef", 2 + p, q), F.array(*[F.lit(0.0)] * q))
        errors = filtered(based, total, "base", theta, q, F.col("row_id") == 0, pos="_pos")
        based = based.select("_g", "_pos", "row_id").join(errors.withColumnRenamed("e", "base"), "_pos")
    raw = F.when(F.col("row_id") >= d + p, F.abs("base"))
    return _filled(materialise(based.select("_g", "row_id", raw.alias("raw")), "arima"), total)


MODELS: dict[str, Callable[[Segments, Sequence[str], dict], DataFrame]] = {
    "pca": _pca, "seasonal_decompose": _seasonal, "prophet": _prophet, "arima": _arima,
}


def raw_scores_by(segments: Segments, features: Sequence[str], model: str, options: dict | None = None) -> DataFrame:
    if model not in MODELS:
        raise ValueError(f"{model} has no model per series; expected one of {sorted(MODELS)}")
    return MODELS[model](segments, features, options or {})
