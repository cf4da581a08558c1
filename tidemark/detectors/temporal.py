"""Detectors on one ordered series; several features are averaged per row first."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.detectors.base import Detector
from tidemark.frame import Frame
from tidemark.functions.scalars import row_mean
from tidemark.operators.linalg import gram
from tidemark.operators.order import over_blocks
from tidemark.operators.quantile import median
from tidemark.operators.recursion import filtered
from tidemark.operators.series import detect_period, fill_median, moving_average_residual, seasonal_residual
from tidemark.session import materialise


def univariate(frame: Frame) -> DataFrame:
    return frame.df.select("row_id", row_mean(list(frame.features)).alias("y"))


class SeasonalDecompose(Detector):
    name = "seasonal_decompose"
    defaults = {"model": "additive", "period": None, "contamination": 0.1}
    normaliser = (0.05, 0.95)

    def raw_scores(self, frame: Frame) -> DataFrame:
        series = materialise(univariate(frame), "series")
        period = self.options["period"] or detect_period(series, frame.n)
        if frame.n < 2 * period:
            return moving_average_residual(series, frame.n)
        return seasonal_residual(series, frame.n, period, self.options["model"])


class Prophet(Detector):
    """Piecewise-linear trend with daily and weekly Fourier terms, one row per hour.

    The normal equations are one aggregate; the prior on slope changes is Laplace
    (solved by reweighted ridge on the driver, about 40 unknowns), on
    seasonality normal.
    """

    name = "prophet"
    defaults = {"changepoint_prior_scale": 0.05, "seasonality_prior_scale": 10.0, "contamination": 0.1}
    normaliser = (0.05, 0.95)
    CHANGEPOINTS, CHANGE_RANGE = 25, 0.8
    SEASONS = ((24, 4), (168, 3))  # (period in rows, Fourier order)

    def _design(self, n: int):
        t = F.col("row_id") / F.lit(float(max(n - 1, 1)))
        hinges = max(0, min(self.CHANGEPOINTS, int(n * self.CHANGE_RANGE) - 1))
        at = np.linspace(0, self.CHANGE_RANGE, hinges + 1)[1:]
        cols = [F.lit(1.0), t, *[F.greatest(t - F.lit(float(s)), F.lit(0.0)) for s in at]]
        for period, order in self.SEASONS:
            # the phase is reduced first, so that long series keep their digits
            phase = F.pmod(F.col("row_id"), F.lit(period)) * F.lit(2 * math.pi / period)
            for k in range(1, order + 1):
                cols += [F.sin(phase * k), F.cos(phase * k)]
        return cols, hinges

    def raw_scores(self, frame: Frame) -> DataFrame:
        series = materialise(univariate(frame), "series")
        cols, hinges = self._design(frame.n)
        top = series.agg(F.max(F.abs("y"))).first()[0] or 1.0
        y = F.col("y") / F.lit(top)
        d = len(cols)
        products, rows = gram(series, F.array(*cols, y), d + 1)
        beta = self._solve(products[:d, :d], products[:d, d], products[d, d], rows, hinges)
        fitted = sum((c * F.lit(float(b)) for c, b in zip(cols[1:], beta[1:])), cols[0] * F.lit(float(beta[0])))
        return series.select("row_id", (F.abs(y - fitted) * F.lit(top)).alias("raw"))

    def _solve(self, xx, xy, yy, rows, hinges) -> np.ndarray:
        d = len(xy)
        laplace = self.options["changepoint_prior_scale"]
        ridge = np.full(d, 1.0 / self.options["seasonality_prior_scale"] ** 2)
        ridge[:2] = 1.0 / 5.0**2
        change = slice(2, 2 + hinges)
        ridge[change] = 1.0 / laplace**2
        noise, beta = max(yy / max(rows, 1), 1e-12), np.zeros(d)
        for _ in range(100):
            beta = np.linalg.solve(xx + noise * np.diag(ridge) + 1e-9 * np.eye(d), xy)
            ridge[change] = 1.0 / (laplace * (np.abs(beta[change]) + 1e-6))
            noise = max((yy - 2 * beta @ xy + beta @ xx @ beta) / max(rows, 1), 1e-12)
        return beta


class Arima(Detector):
    """ARIMA(p, d, q) by Hannan-Rissanen; the score is the one-step residual.

    Coefficients come from normal equations on lag columns, with the differenced
    series clipped to median +- 4 robust deviations so that outliers do not bend
    the fit.  ``coefficients`` (constant, phi, theta) skip the fit.  The residuals are the exact recursion from the
    first row on (``operators/recursion.py``).  A fitted moving-average part that does not forget its start is
    replaced by the one with the same autocovariances that does: roots beyond the unit circle by their inverses.
    """

    name = "arima"
    defaults = {"order": (1, 1, 1), "contamination": 0.1, "coefficients": None}
    normaliser = (0.05, 0.95)

    def raw_scores(self, frame: Frame) -> DataFrame:
        p, d, q = self.options["order"]
        series = univariate(frame)
        for _ in range(d):
            series = over_blocks(series, frame.n, {"_prev": lambda w: F.lag("y").over(w)}, 1)
            series = series.select("row_id", (F.col("y") - F.col("_prev")).alias("y"))
        series = materialise(series.withColumnRenamed("y", "w"), "differences")
        if self.options["coefficients"] is not None:
            const, phi, theta = self.options["coefficients"]
            return fill_median(self._residuals(series, frame.n, d, const, np.asarray(phi, float), np.asarray(theta, float)))
        mid = median(series, "w")
        if mid is None:
            return frame.df.select("row_id", F.lit(0.0).alias("raw"))
        spread = 4 * 1.4826 * median(series.select(F.abs(F.col("w") - F.lit(mid)).alias("w")), "w")
        clipped = F.greatest(F.least(F.col("w"), F.lit(mid + spread)), F.lit(mid - spread)) if spread > 0 else F.col("w")
        series = series.withColumn("c", clipped)
        const, phi, theta = self._fit(series, frame.n, p, q, with_const=d == 0)
        return fill_median(self._residuals(series, frame.n, d, const, phi, theta))

    def _lagged(self, df, n, spec):
        exprs = {
            f"{c}_{k}": (lambda w, c=c, k=k: F.lag(c, k).over(w)) for c, m in spec for k in range(1, m + 1)
        }
        return over_blocks(df, n, exprs, max([m for _, m in spec], default=0)), list(exprs)

    def _regress(self, df, target, inputs, with_const):
        terms = [F.lit(1.0)] * with_const + [F.col(c) for c in inputs]
        if not terms:
            return np.zeros(0)
        whole = df.where(" and ".join(f"{c} is not null" for c in [target, *inputs]))
        products, _ = gram(whole, F.array(*terms, F.col(target)), len(terms) + 1)
        return np.linalg.lstsq(products[:-1, :-1], products[:-1, -1], rcond=None)[0]

    def _fit(self, series, n, p, q, with_const):
        if q == 0:
            lagged, names = self._lagged(series, n, [("c", p)]) if p else (series, [])
            coef = self._regress(lagged, "c", names, with_const)
            return (coef[0] if with_const else 0.0), coef[int(with_const):], np.zeros(0)
        long_order = max(10, 2 * (p + q))
        lagged, names = self._lagged(series, n, [("c", long_order)])
        coef = self._regress(lagged, "c", names, with_const)
        terms = [F.lit(1.0)] * with_const + [F.col(c) for c in names]
        shock = F.col("c") - sum((t * F.lit(float(b)) for t, b in zip(terms, coef)), F.lit(0.0))
        shocks = materialise(lagged.select("row_id", "c", shock.alias("e")), "shocks")
        lagged, names = self._lagged(shocks, n, [("c", p), ("e", q)])
        coef = self._regress(lagged, "c", names, with_const)
        const = coef[0] if with_const else 0.0
        coef = coef[int(with_const):]
        return const, coef[:p], self._invertible(coef[p:])

    @staticmethod
    def _invertible(theta: np.ndarray) -> np.ndarray:
        """The same autocovariances (up to scale) with every root of the recursion inside or on the unit circle."""
        roots = np.roots([1.0, *theta]) if len(theta) else np.zeros(0)
        outside = np.abs(roots) > 1.0
        if not outside.any():
            return theta
        return np.real(np.poly(np.where(outside, 1.0 / np.conj(np.where(outside, roots, 1.0)), roots)))[1:]

    def _residuals(self, series, n, d, const, phi, theta) -> DataFrame:
        p, q = len(phi), len(theta)
        start = d + p  # first row with a full history
        lagged, names = self._lagged(series.select("row_id", "w"), n, [("w", p)]) if p else (series.select("row_id", "w"), [])
        base = F.col("w") - F.lit(float(const))
        for f, name in zip(phi, names):
            base = base - F.lit(float(f)) * F.col(name)
        based = materialise(lagged.select("row_id", base.alias("base")), "arima-base")
        if q:
            based = filtered(based, n, "base", F.array(*[F.lit(float(t)) for t in theta]), q, F.col("row_id") == 0).withColumnRenamed("e", "base")
        return materialise(based.select("row_id", F.when(F.col("row_id") >= start, F.abs("base")).alias("raw")), "arima")
