"""Turning raw scores into [0, 1]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantile import quantiles, quantiles_by
from tidemark.operators.skew import join_series


def minmax(df: DataFrame, raw: str = "raw", out: str = "score", flip: bool = False) -> DataFrame:
    """Min-max; ``flip`` for decision values where small means anomalous.  Constant gives 0."""
    v = -F.col(raw) if flip else F.col(raw)
    row = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    return df.withColumn(out, _ramp(v, row["lo"], row["hi"]))


def quantile_clip(df: DataFrame, low: float, high: float, raw: str = "raw", out: str = "score") -> DataFrame:
    """Linear between two quantiles, clipped to [0, 1]; equal quantiles give 0."""
    lo, hi = quantiles(df, [raw], [low, high])[raw]
    return df.withColumn(out, F.least(F.greatest(_ramp(F.col(raw), lo, hi), F.lit(0.0)), F.lit(1.0)))


def quantile_clip_by(df: DataFrame, series, low: float, high: float, raw: str = "raw", out: str = "score") -> DataFrame:
    q = quantiles_by(df, series, raw, {"_lo": low, "_hi": high})
    ramp = F.when(F.col("_hi") == F.col("_lo"), F.lit(0.0)).otherwise(
        F.least(F.greatest((F.col(raw) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), F.lit(0.0)), F.lit(1.0))
    )
    return join_series(df, q, series).withColumn(out, ramp).drop("_lo", "_hi")


def minmax_by(df: DataFrame, series, raw: str = "raw", out: str = "score") -> DataFrame:
    span = df.groupBy(*series).agg(F.min(raw).alias("_lo"), F.max(raw).alias("_hi"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    ramp = F.when(F.col(raw).isNotNull(), F.coalesce((F.col(raw) - F.col("_lo")) / width, F.lit(0.0)))
    return join_series(df, span, series).withColumn(out, ramp).drop("_lo", "_hi")


def above_one(df: DataFrame, raw: str = "raw", out: str = "score") -> DataFrame:
    """Local-outlier-factor form: excess over 1 relative to the largest excess."""
    top = df.agg(F.max(raw)).first()[0]
    span = max((top if top is not None else 1.0) - 1.0, 1e-8)
    ramp = (F.col(raw) - 1.0) / F.lit(span)
    return df.withColumn(out, F.least(F.greatest(ramp, F.lit(0.0)), F.lit(1.0)))


def contamination_flag(df: DataFrame, contamination: float = 0.1, score: str = "score") -> DataFrame:
    """1 where the score exceeds its (1 - contamination) quantile."""
    cut = quantiles(df, [score], [1.0 - contamination])[score][0]
    return df.withColumn("flag", (F.col(score) > F.lit(cut)).cast("int"))


def _ramp(v, lo, hi):
    if lo is None or hi is None or hi == lo:
        return F.when(v.isNotNull(), F.lit(0.0))
    return (v - F.lit(float(lo))) / F.lit(float(hi) - float(lo))
