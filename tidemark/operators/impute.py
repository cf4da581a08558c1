"""Missing-value strategies: fit is an aggregate, transform a coalesce."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantile import quantiles, quantiles_by
from tidemark.operators.skew import join_series
from tidemark.session import materialise

STRATEGIES = ("mean", "median", "most_frequent", "constant", "drop", "knn")


def missing_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first().asDict()


def fill_values(df: DataFrame, cols: Sequence[str], strategy: str) -> dict[str, float]:
    if strategy == "mean":
        values = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    elif strategy == "median":
        values = {c: q[0] for c, q in quantiles(df, cols, [0.5]).items()}
    elif strategy == "most_frequent":
        values = {c: _mode(df, c) for c in cols}
    elif strategy == "constant":
        values = dict.fromkeys(cols, 0.0)
    else:
        raise ValueError(f"unknown strategy {strategy}; expected one of {STRATEGIES}")
    empty = [c for c, v in values.items() if v is None]
    if empty:
        raise ValueError(f"columns without any value cannot be imputed: {empty}")
    return {c: float(v) for c, v in values.items()}


def _mode(df: DataFrame, c: str):
    """Most frequent value, the smallest on ties; one row leaves the cluster."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max(F.struct("n", (-F.col("v")).alias("neg"))).alias("b")).first()["b"]
    return None if best is None else -best["neg"]


def impute(df: DataFrame, cols: Sequence[str], strategy: str = "mean", row_id: str = "row_id") -> DataFrame:
    """Fill missing features; ``drop`` removes the row, ``knn`` averages five donors."""
    missing = missing_counts(df, cols)
    holes = [c for c, n in missing.items() if n]
    if not holes:
        return df
    if strategy == "drop":
        return df.na.drop(subset=list(cols))
    if strategy == "knn":
        from tidemark.operators.knn_impute import knn_impute

        return knn_impute(df, cols, holes, row_id)
    values = fill_values(df, holes, strategy)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(values[c])) for c in holes})


def impute_by(df: DataFrame, cols: Sequence[str], series: Sequence[str], strategy: str = "mean") -> DataFrame:
    """The same strategies but ``knn``, each series filled with its own values; a series without any value raises."""
    if strategy == "drop":
        return df.na.drop(subset=list(cols))
    if strategy == "constant":
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    fills = None
    if strategy == "mean":
        fills = df.groupBy(*series).agg(*[F.avg(c).alias(f"_fill_{c}") for c in cols])
    elif strategy in ("median", "most_frequent"):
        for c in cols:
            mine = quantiles_by(df, series, c, {f"_fill_{c}": 0.5}) if strategy == "median" else _mode_by(df, series, c)
            fills = mine if fills is None else join_series(fills, mine, series)
    else:
        raise ValueError(f"no strategy {strategy} per series; expected one of {STRATEGIES[:-1]}")
    filled = join_series(df, materialise(fills, "fills"), series)
    filled = filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_fill_{c}")) for c in cols}).select(*df.columns)
    filled = materialise(filled, "filled")
    empty = [c for c, k in missing_counts(filled, cols).items() if k]
    # a series without a value has no fill, or (for medians and modes) no row to join
    if empty or filled.count() != df.count():
        raise ValueError(f"some series have no value to impute: {empty or list(cols)}")
    return filled


def _mode_by(df: DataFrame, series: Sequence[str], c: str) -> DataFrame:
    """Most frequent value of each series, the smallest on ties."""
    counts = df.where(F.col(c).isNotNull()).groupBy(*series, F.col(c).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    return counts.groupBy(*series).agg((-F.max(F.struct("_k", (-F.col("_v")).alias("_neg")))["_neg"]).alias(f"_fill_{c}"))
