"""Feature roles and engineered features."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars
from tidemark.operators.order import over_blocks

# fixed values: parts of a column name that mark it as an identifier
ID_WORDS = ("id", "index")
LAGS = (1, 2, 3)
MAX_PRODUCTS = 5_000  # columns; a wider table is refused, not cut
_ROLLING_TYPES = (T.DoubleType, T.FloatType, T.LongType)


def feature_columns(df: DataFrame, ts: str | None, id_rule: str = "substring") -> list[str]:
    """Numeric columns without the timestamp and without identifiers.

    ``substring`` drops every name containing an id word; ``suffix`` only names
    that are one or end in ``_<word>``.
    """
    if id_rule not in ("substring", "suffix"):
        raise ValueError(f"unknown id_rule {id_rule}")

    def is_id(name: str) -> bool:
        name = name.lower()
        if id_rule == "substring":
            return any(w in name for w in ID_WORDS)
        return any(name == w or name.endswith(f"_{w}") for w in ID_WORDS)

    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name != ts and not is_id(f.name)
    ]


def rolling_features(
    df: DataFrame, cols: Sequence[str], n: int, window: int = 10, series: Sequence[str] = (), pos: str = "row_id"
) -> DataFrame:
    """Trailing mean and sample deviation over ``window`` rows, and lags 1-3 (missing = 0)."""
    exprs = {}
    for c in cols:
        v = F.col(c).cast("double")
        exprs[f"{c}_rolling_mean"] = lambda w, v=v: F.avg(v).over(w.rowsBetween(1 - window, 0))
        exprs[f"{c}_rolling_std"] = lambda w, v=v: F.coalesce(
            F.stddev_samp(v).over(w.rowsBetween(1 - window, 0)), F.lit(0.0)
        )
        for k in LAGS:
            exprs[f"{c}_lag_{k}"] = lambda w, v=v, k=k: F.lag(v, k, 0.0).over(w)
    return over_blocks(df, n, exprs, max(window - 1, *LAGS), series=series, pos=pos)


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns(scalars.calendar(F.col(ts)))


def interaction_features(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Pairwise products of the columns; name fewer columns for fewer products.

    d columns give d * (d - 1) / 2 products; more than ``MAX_PRODUCTS`` raise.
    """
    pairs = list(itertools.combinations(cols, 2))
    if len(pairs) > MAX_PRODUCTS:
        raise ValueError(f"{len(cols)} columns give {len(pairs)} products, more than {MAX_PRODUCTS}: name the columns to multiply")
    out = {f"{a}_x_{b}": F.col(a).cast("double") * F.col(b).cast("double") for a, b in pairs}
    return df.withColumns(out), list(out)


def engineer(
    df: DataFrame,
    cols: Sequence[str],
    n: int,
    ts: str | None = None,
    rolling_types: dict[str, T.DataType] | None = None,
    window: int = 10,
    statistical: bool = True,
    interactions: bool = False,
    series: Sequence[str] = (),
    interaction_columns: Sequence[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """All engineered features; returns the table and its feature names in order.

    ``rolling_types`` are the column types before imputation: only double, float
    and bigint columns get rolling and lag features.  Products are of all features,
    or of those named in ``interaction_columns``.
    """
    types = rolling_types or {f.name: f.dataType for f in df.schema}
    names = list(cols)
    if statistical:
        rolled = [c for c in cols if isinstance(types[c], _ROLLING_TYPES)]
        if rolled:
            before = set(df.columns)
            df = rolling_features(df, rolled, n, window, series)
            names += [c for c in df.columns if c not in before]
    if ts:
        df = calendar_features(df, ts)
        names += [c for c in scalars.calendar(F.col(ts)) if c not in names]
    if interactions:
        unknown = [c for c in interaction_columns or () if c not in names]
        if unknown:
            raise ValueError(f"no features to multiply: {unknown}")
        df, added = interaction_features(df, interaction_columns or names)
        names += added
    return df, names
