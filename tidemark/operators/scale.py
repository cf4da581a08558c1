"""Scalers with population statistics; constant columns become 0."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantile import quantiles, quantiles_by
from tidemark.operators.skew import join_series

METHODS = ("standard", "minmax", "robust")


@dataclass(frozen=True)
class Scaler:
    """(x - shift) / width per column; a zero width is stored as 1."""

    shift: dict[str, float]
    width: dict[str, float]

    def expr(self, c: str):
        return (F.col(c).cast("double") - F.lit(self.shift[c])) / F.lit(self.width[c])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.expr(c) for c in self.shift})


def fit_scaler(df: DataFrame, cols: Sequence[str], method: str = "standard") -> Scaler:
    if method == "standard":
        row = df.agg(
            *[F.avg(c).alias(f"a{i}") for i, c in enumerate(cols)],
            *[F.stddev_pop(c).alias(f"b{i}") for i, c in enumerate(cols)],
            *[F.min(F.col(c).cast("double")).alias(f"l{i}") for i, c in enumerate(cols)],
            *[F.max(F.col(c).cast("double")).alias(f"h{i}") for i, c in enumerate(cols)],
        ).first()
        # a constant column has width 0 whatever rounding left in its deviation
        stats = [
            (row[f"a{i}"], row[f"b{i}"] if row[f"l{i}"] != row[f"h{i}"] else 0.0) for i in range(len(cols))
        ]
        stats = [(row[f"l{i}"], 0.0) if w == 0 else (m, w) for i, (m, w) in enumerate(stats)]
    elif method == "minmax":
        row = df.agg(
            *[F.min(F.col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
            *[F.max(F.col(c).cast("double")).alias(f"b{i}") for i, c in enumerate(cols)],
        ).first()
        stats = [(row[f"a{i}"], _gap(row[f"a{i}"], row[f"b{i}"])) for i in range(len(cols))]
    elif method == "robust":
        q = quantiles(df, cols, [0.25, 0.5, 0.75])
        stats = [(q[c][1], _gap(q[c][0], q[c][2])) for c in cols]
    else:
        raise ValueError(f"unknown scaling method {method}; expected one of {METHODS}")
    shift = {c: float(s) if s is not None else 0.0 for c, (s, _) in zip(cols, stats)}
    width = {c: float(w) if w else 1.0 for c, (_, w) in zip(cols, stats)}
    return Scaler(shift, width)


def _gap(low, high):
    return None if low is None or high is None else high - low


def scale(df: DataFrame, cols: Sequence[str], method: str = "standard") -> DataFrame:
    return fit_scaler(df, cols, method).transform(df)


def scale_by(df: DataFrame, cols: Sequence[str], series: Sequence[str], method: str = "standard") -> DataFrame:
    """The same scalers fitted per series; pre-aggregated, then joined back on the series."""
    if method == "robust":
        stats = None
        for i, c in enumerate(cols):
            q = quantiles_by(df, series, c, {f"_l{i}": 0.25, f"_a{i}": 0.5, f"_h{i}": 0.75})
            q = q.withColumn(f"_b{i}", F.col(f"_h{i}") - F.col(f"_l{i}")).drop(f"_l{i}", f"_h{i}")
            stats = q if stats is None else join_series(stats, q, series)
    elif method in METHODS:
        low = {"standard": F.avg, "minmax": lambda c: F.min(F.col(c).cast("double"))}[method]
        width = {
            "standard": F.stddev_pop,
            "minmax": lambda c: F.max(F.col(c).cast("double")) - F.min(F.col(c).cast("double")),
        }[method]
        # a constant column is one whose extremes agree; rounding must not give it a deviation
        still = lambda c: F.min(F.col(c).cast("double")) == F.max(F.col(c).cast("double"))
        stats = df.groupBy(*series).agg(
            *[low(c).alias(f"_a{i}") for i, c in enumerate(cols)],
            *[F.when(still(c), F.lit(0.0)).otherwise(width(c)).alias(f"_b{i}") for i, c in enumerate(cols)],
        )
    else:
        raise ValueError(f"unknown scaling method {method}; expected one of {METHODS}")
    scaled = {
        c: F.when(F.col(c).isNotNull() & (F.col(f"_b{i}") == 0), F.lit(0.0) if method != "robust" else F.col(c) - F.col(f"_a{i}")).otherwise(
            (F.col(c) - F.col(f"_a{i}")) / F.when(F.col(f"_b{i}") != 0, F.col(f"_b{i}"))
        )
        for i, c in enumerate(cols)
    }
    joined = join_series(df, stats, series)
    return joined.withColumns(scaled).select(*df.columns)
