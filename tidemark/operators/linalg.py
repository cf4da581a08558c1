"""Covariance, normal equations and principal components.

Each task folds its rows into one d x d product; the products are summed by a
grouped aggregate, so d*d numbers reach the driver, whatever the row count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


NARROW = 8  # up to this many columns the products are plain sums
WIDE = 16  # up to this many columns a projection is written as plain expressions
GRAM_COLUMNS = 2048  # beyond, the covariance itself is not formed: its d x d numbers would pass the driver
FIRST_WIDTH, SPARE = 32, 10  # directions that a share of variance is tried with, and those beyond the wanted ones


def vector_of(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def gram(df: DataFrame, vector: Column, d: int) -> tuple[np.ndarray, int]:
    """Sum of v v' over all rows, and the row count; rows with a NULL vector are skipped."""

    if d <= NARROW:
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        row = (
            df.select(vector.alias("v"))
            .where("v is not null")
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i] * F.col("v")[j]) for i, j in pairs])
            .first()
        )
        out = np.zeros((d, d))
        for (i, j), value in zip(pairs, row[1:]):
            out[i, j] = out[j, i] = value or 0.0
        return out, row["n"]

    def fold(batches):
        total = np.zeros((d, d))
        rows = 0
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy())
                total += x.T @ x
                rows += len(x)
        if rows:
            yield pd.DataFrame({"i": range(d), "part": list(total), "rows": rows})

    parts = df.select(vector.alias("v")).where("v is not null").mapInPandas(
        fold, "i int, part array<double>, rows bigint"
    )
    cells = (
        parts.select("i", "rows", F.posexplode("part").alias("j", "value"))
        .groupBy("i", "j")
        .agg(F.sum("value").alias("value"), F.sum("rows").alias("rows"))
        .toPandas()
    )
    out = np.zeros((d, d))
    if len(cells):
        out[cells["i"], cells["j"]] = cells["value"]
    return out, int(cells["rows"].max()) if len(cells) else 0


def means(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return np.array([row[i] if row[i] is not None else 0.0 for i in range(len(cols))])


def covariance(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, sample covariance, rows); centred first so that large means cost no digits."""
    mean = means(df, cols)
    centred = F.array(*[F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(cols, mean)])
    total, rows = gram(df, centred, len(cols))
    return mean, total / max(rows - 1, 1), rows


@dataclass(frozen=True)
class Pca:
    columns: tuple[str, ...]
    mean: np.ndarray
    components: np.ndarray  # k x d, rows are unit vectors
    variances: np.ndarray  # eigenvalues, descending: all d, or the found ones beyond GRAM_COLUMNS
    total: float | None = None  # variance of all columns, where not all eigenvalues are known
    residual: float = 0.0  # each kept variance is this close to an eigenvalue of the covariance

    @property
    def ratios(self) -> np.ndarray:
        total = self.variances.sum() if self.total is None else self.total
        return self.variances / total if total > 0 else np.zeros_like(self.variances)

    @property
    def k(self) -> int:
        return len(self.components)

    @property
    def explained(self) -> float:
        return float(self.ratios[: self.k].sum())

    def importance(self) -> dict[str, float]:
        """Sum of absolute loadings per input column, largest first."""
        weight = np.abs(self.components).sum(axis=0)
        return dict(sorted(zip(self.columns, map(float, weight)), key=lambda kv: -kv[1]))

    def _centred(self) -> list[Column]:
        return [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(self.columns, self.mean)]

    def projections(self) -> dict[str, Column]:
        x = self._centred()
        return {f"PC_{i + 1}": _dot(x, w) for i, w in enumerate(self.components)}

    def transform(self, df: DataFrame) -> DataFrame:
        if len(self.columns) <= WIDE:
            return df.withColumns(self.projections())
        base, mean = self.components, self.mean
        out = df.withColumn("_pc", _matrix_udf(vector_of(self.columns), lambda x: (x - mean) @ base.T))
        return out.withColumns({f"PC_{i + 1}": F.col("_pc")[i] for i in range(self.k)}).drop("_pc")

    def with_residual(self, df: DataFrame, out: str = "raw") -> DataFrame:
        """Mean squared reconstruction error per row."""
        d = len(self.columns)
        if d <= WIDE:
            left_out = np.eye(d) - self.components.T @ self.components
            x = self._centred()
            squares = [e * e for e in (_dot(x, row) for row in left_out)]
            return df.withColumn(out, sum(squares[1:], squares[0]) / F.lit(float(d)))
        mean, base = self.mean, self.components

        @F.pandas_udf("double")
        def error(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy()) - mean
            return pd.Series(((x - (x @ base.T) @ base) ** 2).mean(1))

        return df.withColumn(out, error(vector_of(self.columns)))


def _dot(x: Sequence[Column], weights) -> Column:
    terms = [a * F.lit(float(b)) for a, b in zip(x, weights)]
    return sum(terms[1:], terms[0])


def _matrix_udf(vector: Column, function) -> Column:
    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        return pd.Series(list(function(np.stack(v.to_numpy()))))

    return apply(vector)


def components_for(ratios: np.ndarray, share: float, inclusive: bool = False) -> int:
    """Fewest components whose cumulative ratio exceeds (or reaches) ``share``."""
    cumulative = np.cumsum(ratios)
    side = "left" if inclusive else "right"
    return int(min(np.searchsorted(cumulative, share, side=side) + 1, len(ratios)))


def principal(cov: np.ndarray, n_components: float | int) -> tuple[np.ndarray, np.ndarray]:
    """(components to keep as rows, all variances) of a covariance matrix, largest first."""
    values, vectors = np.linalg.eigh(cov)
    values = np.clip(values[::-1], 0.0, None)
    vectors = vectors[:, ::-1].T
    # sign rule: the largest loading of a component is positive
    top = np.abs(vectors).argmax(axis=1)
    vectors = vectors * np.where(vectors[np.arange(len(top)), top] < 0, -1.0, 1.0)[:, None]
    total = values.sum()
    if isinstance(n_components, float) and n_components < 1:
        ratios = values / total if total > 0 else np.zeros_like(values)
        k = components_for(ratios, n_components) if total > 0 else len(values)
    else:
        k = min(int(n_components), len(values))
    return vectors[:k], values


def fit_pca(df: DataFrame, cols: Sequence[str], n_components: float | int = 0.95) -> Pca:
    if len(cols) > GRAM_COLUMNS:
        return fit_wide_pca(df, cols, n_components)
    mean, cov, _ = covariance(df, cols)
    components, values = principal(cov, n_components)
    return Pca(tuple(cols), mean, components, values)


def _folded(df: DataFrame, vector: Column, make, d: int, width: int) -> np.ndarray:
    """Sum over all batches of the d x width matrix that ``make`` gives for the rows of one."""

    def fold(batches):
        total = np.zeros((d, width))
        for batch in batches:
            if len(batch):
                total += make(np.stack(batch["v"].to_numpy()))
        yield pd.DataFrame({"i": range(d), "part": list(total)})

    parts = df.select(vector.alias("v")).where("v is not null").mapInPandas(fold, "i int, part array<double>")
    cells = parts.select("i", F.posexplode("part").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros((d, width))
    out[cells["i"], cells["j"]] = cells["value"]
    return out


def fit_wide_pca(df: DataFrame, cols: Sequence[str], n_components: float | int = 0.95,
                 tolerance: float = 1e-6, rounds: int = 60) -> Pca:
    """Leading components by randomised subspace iteration, for columns whose covariance is too large to hold.

    A round is one job: tasks multiply their centred rows with a few directions, and d x width numbers reach the
    driver.  There a small eigenproblem turns the directions into estimates of components, and what the covariance
    makes of each, less its multiple, bounds the error of its variance.  Rounds end when that bound is at most
    ``tolerance`` of the largest variance for all kept components, or after ``rounds``; ``residual`` states it.
    Where a share of the variance is asked for, directions are doubled until they hold it.
    """
    d, vector = len(cols), vector_of(cols)
    first = _folded(df, vector, lambda x: np.column_stack([x.sum(0), np.full(d, len(x))]), d, 2)
    rows = first[0, 1]
    mean = first[:, 0] / max(rows, 1)
    share = n_components if isinstance(n_components, float) and n_components < 1 else None
    width = min(d, (FIRST_WIDTH if share else int(n_components)) + SPARE)
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(d, width)))[0]

    for _ in range(max(rounds, 1)):
        def product(x, q=q):
            x = x - mean
            return np.column_stack([x.T @ (x @ q), (x * x).sum(0)])

        scatter = _folded(df, vector, product, d, width + 1) / max(rows - 1, 1)
        image, total = scatter[:, :-1], scatter[:, -1].sum()
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = np.clip(values[::-1], 0.0, None), turn[:, ::-1]
        basis = q @ turn
        errors = np.linalg.norm(image @ turn - basis * values, axis=0)
        if share and total > 0:
            k = int(np.searchsorted(np.cumsum(values) / total, share, side="right")) + 1
            if k > width - SPARE and width < d:
                more = min(d, 2 * width) - width
                q = np.linalg.qr(np.column_stack([image @ turn, rng.normal(size=(d, more))]))[0]
                width += more
                continue
            k = min(k, width)
        else:
            k = width if share else min(int(n_components), d)
        if errors[:k].max() <= tolerance * values[0]:
            break
        q = np.linalg.qr(image)[0]
    kept = basis.T[:k]
    top = np.abs(kept).argmax(axis=1)
    kept = kept * np.where(kept[np.arange(len(top)), top] < 0, -1.0, 1.0)[:, None]
    return Pca(tuple(cols), mean, kept, values, float(total), float(errors[:k].max()))
