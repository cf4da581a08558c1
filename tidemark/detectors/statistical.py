"""Detectors on feature vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.detectors.base import Detector
from tidemark.frame import Frame
from tidemark.operators.cells import linked_cells
from tidemark.operators.linalg import fit_pca
from tidemark.operators.neighbours import Points, distinct_points, knn_points
from tidemark.operators.order import number_rows
from tidemark.operators.quantile import quantiles
from tidemark.operators.sampling import hashed_share
from tidemark.operators.scale import scale
from tidemark.operators.skew import join_unique
from tidemark.session import materialise, shuffle_partitions

EULER = 0.5772156649


def unit_scaled(frame: Frame) -> Frame:
    return frame.with_df(scale(frame.df, frame.features, "minmax"))


CHUNK = 2048  # rows worked on at once, so that what is derived from them stays in the processor's cache


def matrix_of(column: pa.ListArray) -> np.ndarray:
    """Arrays of one length as a matrix, without an object per row."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def array_score(vector, function):
    """Arrow UDF from an array column to one double per row; ``function`` maps a matrix to a vector."""

    @F.arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        x = matrix_of(batch)
        parts = [np.asarray(function(x[at : at + CHUNK]), dtype=float) for at in range(0, len(x), CHUNK)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), type=pa.float64())

    return score(vector)


def packed_rows(data: DataFrame) -> DataFrame:
    """The arrays ``v`` as bytes of whole chunks, column by column: what is read in every round of a fit."""

    def pack(batches):
        for batch in batches:
            x = matrix_of(batch.column(0))
            parts = [x[at : at + CHUNK] for at in range(0, len(x), CHUNK)]
            yield pa.RecordBatch.from_pydict({
                "rows": pa.array([len(p) for p in parts], type=pa.int32()),
                "cells": pa.array([np.ascontiguousarray(p.T).tobytes() for p in parts], type=pa.binary()),
            })

    return materialise(data.select("v").mapInArrow(pack, "rows int, cells binary"), "packed")


def fold_rows(packed: DataFrame, function, size: int) -> np.ndarray:
    """Sum over the chunks of ``function(matrix)``, folded per task and summed on the cluster."""

    def fold(batches):
        total = np.zeros(size)
        for batch in batches:
            for rows, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                total += function(np.frombuffer(cells.as_buffer()).reshape(-1, rows).T)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(size, dtype=np.int32)), "part": pa.array(total)})

    out = np.zeros(size)
    sums = packed.select("rows", "cells").mapInArrow(fold, "i int, part double").groupBy("i").agg(F.sum("part").alias("s")).toPandas()
    out[sums["i"]] = sums["s"]
    return out


# ---------------------------------------------------------------- isolation forest


def average_path(n):
    """Mean depth of an unsuccessful search among ``n`` values."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(big - 1) + EULER) - 2 * (big - 1) / big))


class IsolationForest(Detector):
    """Trees on small subsamples grow in parallel; only their nodes are collected."""

    name = "isolation_forest"
    defaults = {"n_estimators": 100, "max_samples": 256, "random_state": 42, "contamination": 0.1}

    _NODES = "tree int, node int, feature int, cut double, left int, right int, depth double"

    def fit(self, frame: Frame) -> pd.DataFrame:
        trees, psi = self.options["n_estimators"], min(self.options["max_samples"], frame.n)
        seed = self.options["random_state"]
        d = len(frame.features)
        rows = frame.df.select("row_id", frame.vector().alias("v"))
        # rows in the order of a hash are dealt out in turn, from the first again after the last: every tree
        # gets exactly psi different rows, whatever the size of the table
        wanted = min(frame.n, trees * psi)
        order = F.xxhash64(F.lit(seed), F.col("row_id"))
        near = hashed_share(rows, F.col("row_id"), wanted, frame.n, seed)
        near = near if near.count() >= wanted else rows
        drawn = materialise(near.withColumn("_h", order).orderBy("_h", "row_id").limit(wanted), "forest-rows")
        placed = drawn.withColumn("_at", F.row_number().over(Window.orderBy("_h", "row_id")) - 1)
        turns = F.explode(F.sequence(F.col("_at"), F.lit(trees * psi - 1), F.lit(frame.n)))
        dealt = placed.select("row_id", "v", turns.alias("_turn")).withColumn("tree", F.floor(F.col("_turn") / psi).cast("int"))
        sample = dealt.repartition(shuffle_partitions(frame.df.sparkSession), "tree")

        def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(pdf.sort_values("row_id")["v"].to_numpy())
            rng = np.random.default_rng([seed, int(key[0])])
            limit = math.ceil(math.log2(max(len(x), 2)))
            nodes = []

            def split(rows_, depth):
                at = len(nodes)
                nodes.append(None)
                part = x[rows_]
                low, high = part.min(0), part.max(0)
                open_ = np.flatnonzero(high > low)
                if depth >= limit or len(rows_) <= 1 or not len(open_):
                    nodes[at] = (at, -1, 0.0, at, at, depth + float(average_path(len(rows_))))
                    return at
                f = int(rng.choice(open_))
                cut = float(rng.uniform(low[f], high[f]))
                goes = part[:, f] < cut
                if not goes.any() or goes.all():
                    cut = float(high[f])
                    goes = part[:, f] < cut
                left = split(rows_[goes], depth + 1)
                right = split(rows_[~goes], depth + 1)
                nodes[at] = (at, f, cut, left, right, 0.0)
                return at

            split(np.arange(len(x)), 0)
            out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "depth"])
            out.insert(0, "tree", int(key[0]))
            return out

        # at most trees * (2 * psi - 1) rows
        return sample.groupBy("tree").applyInPandas(grow, self._NODES).toPandas()

    def raw_scores(self, frame: Frame) -> DataFrame:
        psi = min(self.options["max_samples"], frame.n)
        if psi <= 1:
            return frame.df.select("row_id", F.lit(0.0).alias("raw"))
        nodes = self.fit(frame).sort_values(["tree", "node"])
        first = nodes.groupby("tree")["node"].size().cumsum().shift(fill_value=0)
        base = nodes["tree"].map(first).to_numpy()
        feature = nodes["feature"].to_numpy()
        cut, depth = nodes["cut"].to_numpy(), nodes["depth"].to_numpy()
        left, right = nodes["left"].to_numpy() + base, nodes["right"].to_numpy() + base
        roots = first.to_numpy()
        steps = math.ceil(math.log2(max(psi, 2)))
        scale_ = float(average_path(psi))
        model = frame.df.sparkSession.sparkContext.broadcast((roots, feature, cut, left, right, depth))

        def score(x: np.ndarray) -> np.ndarray:
            roots_, feature_, cut_, left_, right_, depth_ = model.value
            total = np.zeros(len(x))
            at_row = np.arange(len(x))
            for root in roots_:
                at = np.full(len(x), root)
                for _ in range(steps):
                    f = feature_[at]
                    goes = x[at_row, np.maximum(f, 0)] < cut_[at]
                    at = np.where(goes, left_[at], right_[at])
                total += depth_[at]
            return 2.0 ** (-(total / len(roots_)) / scale_)

        return frame.df.select("row_id", array_score(frame.vector(), score).alias("raw"))


# ---------------------------------------------------------------- principal components


class PcaDetector(Detector):
    name = "pca"
    defaults = {"n_components": 0.95, "contamination": 0.1}
    normaliser = (0.01, 0.99)

    def raw_scores(self, frame: Frame) -> DataFrame:
        scaled = unit_scaled(frame)
        model = fit_pca(scaled.df, scaled.features, self.options["n_components"])
        return model.with_residual(scaled.df).select("row_id", "raw")


# ---------------------------------------------------------------- one-class SVM


def nearest_to_origin(points: np.ndarray) -> np.ndarray:
    """Weights of the point nearest to the origin in the convex hull of the rows (Wolfe's active set)."""
    products = points @ points.T
    scale_ = max(float(np.trace(products)) / len(points), 1e-300)
    active, weights = [int(np.argmin(np.diag(products)))], np.ones(1)
    for _ in range(50 * len(points)):
        toward = products[:, active] @ weights
        best = int(np.argmin(toward))
        if toward[best] > weights @ products[np.ix_(active, active)] @ weights - 1e-12 * scale_ or best in active:
            break
        active, weights = [*active, best], np.append(weights, 0.0)
        while True:
            # nearest point of the flat through the active rows
            k = len(active)
            system = np.zeros((k + 1, k + 1))
            system[:k, :k], system[:k, k], system[k, :k] = products[np.ix_(active, active)], 1.0, 1.0
            flat = np.linalg.lstsq(system, np.append(np.zeros(k), 1.0), rcond=None)[0][:k]
            if (flat > 1e-12).all():
                weights = flat
                break
            # walk towards it until the first weight is used up
            down = flat <= 1e-12
            step = np.min(weights[down] / np.maximum(weights[down] - flat[down], 1e-300))
            weights = weights + min(step, 1.0) * (flat - weights)
            keep = weights > 1e-12
            active, weights = [i for i, good in zip(active, keep) if good], weights[keep] / weights[keep].sum()
    out = np.zeros(len(points))
    out[active] = weights
    return out


class OneClassSvm(Detector):
    """Primal nu-SVM on random Fourier features, by cutting planes, with a certificate.

    With nu n rows at weight 1 / (nu n), the sum of the lowest margins is a plane below the loss, wherever it was
    taken; so the answer to all planes so far (the point of their hull nearest to the origin, a small problem on
    the driver) bounds the objective from below, and its own loss from above.  A round is two jobs, a histogram of
    margins and a sum of vectors, and the planes are all it keeps.  It stops once the gap between the bounds is at
    most ``tolerance`` of the objective, or after ``rounds``; ``describe`` states the gap that was reached.
    The offset rho is the exact nu-quantile of the margins.
    """

    name = "one_class_svm"
    defaults = {"nu": 0.1, "kernel": "rbf", "gamma": "scale", "features": 256, "rounds": 200, "tolerance": 0.01, "random_state": 42}
    _BINS = 4096

    def raw_scores(self, frame: Frame) -> DataFrame:
        scaled = unit_scaled(frame)
        data = materialise(scaled.df.select("row_id", scaled.vector().alias("v")), "svm")
        packed = packed_rows(data)
        lift, size = self._lift(scaled)
        low_rows = max(self.options["nu"] * frame.n, 1.0)
        planes = [fold_rows(packed, lambda x: lift(x).sum(0, dtype=float), size) / frame.n]
        w = planes[0]
        for done in range(1, self.options["rounds"] + 1):
            plane, loss = self._plane(packed, lift, size, w, low_rows)
            lower, upper = -0.5 * float(w @ w), 0.5 * float(w @ w) + loss
            self.certificate = {"rounds": done, "objective": upper, "lower_bound": lower, "gap": upper - lower}
            if upper - lower <= self.options["tolerance"] * abs(lower):
                break
            planes.append(plane)
            stacked = np.stack(planes)
            weights = nearest_to_origin(stacked)
            planes = [p for p, used in zip(planes, weights) if used > 0]
            w = weights @ stacked
        margins = materialise(data.select("row_id", array_score(F.col("v"), lambda x, w=w: lift(x) @ w).alias("m")), "margins")
        rho = quantiles(margins, ["m"], [self.options["nu"]], n=frame.n)["m"][0]
        return margins.select("row_id", (F.lit(rho) - F.col("m")).alias("raw"))

    def describe(self) -> dict:
        return {**super().describe(), "certificate": getattr(self, "certificate", None)}

    def _plane(self, packed: DataFrame, lift, size: int, w: np.ndarray, low_rows: float) -> tuple[np.ndarray, float]:
        """Mean vector of the ``low_rows`` rows with the lowest margins, and an upper bound of the loss at ``w``.

        The rows inside the bin that holds the last of them share the weight that is left.
        """
        low, high = self._bracket(packed, lift, w, low_rows)
        sums = fold_rows(packed, lambda x: _parted(lift(x), w, low, high), 2 * size + 2)
        below, inside, n_below, n_inside = sums[:size], sums[size: 2 * size], sums[-2], sums[-1]
        share = (low_rows - n_below) / n_inside if n_inside else 0.0
        short = (n_below + n_inside) * high - float(w @ (below + inside))
        return (below + share * inside) / low_rows, short / low_rows - high

    def _lift(self, scaled: Frame):
        d = len(scaled.features)
        if self.options["kernel"] == "linear":
            return (lambda x: x), d
        if self.options["kernel"] != "rbf":
            raise ValueError(f"unknown kernel {self.options['kernel']}")
        gamma = self.options["gamma"]
        if gamma == "scale":
            cells = scaled.df.agg(
                *[F.avg(c).alias(f"a{i}") for i, c in enumerate(scaled.features)],
                *[F.avg(F.col(c) * F.col(c)).alias(f"b{i}") for i, c in enumerate(scaled.features)],
            ).first()
            m = np.mean([cells[f"a{i}"] for i in range(d)])
            variance = np.mean([cells[f"b{i}"] for i in range(d)]) - m * m
            gamma = 1.0 / (d * variance) if variance > 0 else 1.0
        elif gamma == "auto":
            gamma = 1.0 / d
        size = self.options["features"]
        rng = np.random.default_rng(self.options["random_state"])
        weights = rng.normal(0.0, math.sqrt(2.0 * gamma), (d, size))
        phase = rng.uniform(0.0, 2.0 * math.pi, size)

        def lift(x: np.ndarray) -> np.ndarray:
            # the angle in full precision, less whole turns; its cosine in single precision, which is many times faster
            angle = x @ weights + phase
            angle -= np.rint(angle * (0.5 / math.pi)) * (2.0 * math.pi)
            return math.sqrt(2.0 / size) * np.cos(angle.astype(np.float32)).astype(float)

        return lift, size

    def _bracket(self, packed: DataFrame, lift, w: np.ndarray, low_rows: float) -> tuple[float, float]:
        """Edges of the bin in which the ``low_rows`` lowest margins end."""
        span = max(float(np.linalg.norm(w)) * 2.0, 1e-12)
        if self.options["kernel"] == "linear":
            span = max(float(np.abs(w).sum()), 1e-12)
        bins = self._BINS
        edges = np.linspace(-span, span, bins + 1)
        edges[0], edges[-1] = -np.inf, np.inf
        counts = fold_rows(packed, lambda x: np.bincount(np.searchsorted(edges, lift(x) @ w, "right") - 1, minlength=bins)[:bins], bins)
        at = int(np.searchsorted(np.cumsum(counts), low_rows))
        return float(edges[at]), float(min(edges[at + 1], span * 1.001))


def _parted(z: np.ndarray, w: np.ndarray, low: float, high: float) -> np.ndarray:
    """Sums of the rows below ``low`` and of those from ``low`` to below ``high``, and their numbers."""
    margins = z @ w
    below, inside = margins < low, (margins >= low) & (margins < high)
    return np.concatenate([below @ z, inside @ z, [below.sum(), inside.sum()]])


# ---------------------------------------------------------------- local outlier factor


def local_outlier_factors(points: Points, k: int) -> DataFrame:
    """pid, lof.  All copies of a vector share their factor, so it is computed per point."""
    near = knn_points(points.table, points.table, points.n_points, k + 1)
    # a row is not its own neighbour: drop one id of the point itself
    ids = F.when(F.col("pid") == F.col("nbr"), F.slice("ids", 2, k + 1)).otherwise(F.col("ids"))
    w = Window.partitionBy("pid").orderBy("dist", "id")
    pairs = materialise(
        near.select("pid", "nbr", "dist", F.explode(ids).alias("id"))
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= k)
        .select("pid", "nbr", "dist"),
        "pairs",
    )
    reach = pairs.groupBy("pid").agg(F.max("dist").alias("k_dist"))
    density = materialise(
        pairs.join(reach.withColumnRenamed("pid", "nbr"), "nbr")
        .groupBy("pid")
        .agg((1.0 / (F.avg(F.greatest("k_dist", "dist")) + 1e-10)).alias("lrd")),
        "density",
    )
    around = (
        pairs.join(density.select(F.col("pid").alias("nbr"), F.col("lrd").alias("nbr_lrd")), "nbr")
        .groupBy("pid")
        .agg(F.avg("nbr_lrd").alias("around"))
    )
    return around.join(density, "pid").select("pid", (F.col("around") / F.col("lrd")).alias("lof"))


class LocalOutlierFactor(Detector):
    name = "local_outlier_factor"
    defaults = {"n_neighbors": 20, "contamination": 0.1}
    normaliser = "above_one"

    def raw_scores(self, frame: Frame) -> DataFrame:
        k = min(self.options["n_neighbors"], frame.n - 1)
        if k < 1:
            return frame.df.select("row_id", F.lit(1.0).alias("raw"))
        points = distinct_points(frame.df, frame.vector(), keep=k + 1)
        return points.spread(local_outlier_factors(points, k)).select("row_id", F.col("lof").alias("raw"))


# ---------------------------------------------------------------- DBSCAN


def _cell_side(eps: float, d: int) -> float:
    """Side of a grid cell whose diagonal stays below eps."""
    return eps / math.sqrt(d) * (1 - 1e-9)


def core_points(points: Points, d: int, eps: float, min_samples: int) -> DataFrame:
    """pid, v, core.  Copies and crowded grid cells settle most points without distances.

    Two points of one cell of side eps / sqrt(d) are within eps of each other, so a
    cell with ``min_samples`` rows holds only core points.  The rest ask for their
    ``min_samples`` nearest rows within eps.
    """
    cells = F.transform("v", lambda x: F.floor(x / F.lit(_cell_side(eps, d))))
    crowded = points.table.withColumn("_cell", cells)
    totals = crowded.groupBy("_cell").agg(F.sum("copies").alias("_rows"))
    placed = materialise(
        join_unique(crowded, totals, "_cell", points.n_points).select(
            "pid", "v", "ids", "copies", (F.col("_rows") >= min_samples).alias("sure")
        ),
        "cells",
    )
    asking = placed.where(~F.col("sure")).select("pid", "v")
    if not asking.count():
        return placed.select("pid", "v", "ids", F.col("sure").alias("core"))
    near = knn_points(asking, placed.select("pid", "v", F.slice("ids", 1, min_samples).alias("ids")),
                      points.n_points, min_samples, radius=eps)
    counted = near.groupBy("pid").agg(F.sum(F.size("ids")).alias("_near"))
    return placed.join(counted, "pid", "left").select(
        "pid", "v", "ids", (F.col("sure") | (F.coalesce("_near", F.lit(0)) >= min_samples)).alias("core")
    )


class Dbscan(Detector):
    """Noise rows score their distance to the nearest core point; all others 0."""

    name = "dbscan"
    defaults = {"eps": 0.5, "min_samples": 5}
    normaliser = "none"

    def raw_scores(self, frame: Frame) -> DataFrame:
        scaled = unit_scaled(frame)
        eps, need = self.options["eps"], self.options["min_samples"]
        points = distinct_points(scaled.df, scaled.vector(), keep=need)
        flagged = materialise(core_points(points, len(scaled.features), eps, need), "core")
        cores = flagged.where("core")
        n_cores = cores.count()
        if not n_cores:
            return frame.df.select("row_id", F.lit(1.0).alias("raw"))
        rest = flagged.where(~F.col("core"))
        if n_cores == points.n_points:
            return frame.df.select("row_id", F.lit(0.0).alias("raw"))
        gap = materialise(
            knn_points(rest.select("pid", "v"), cores.select("pid", "v", "ids"), n_cores, 1).where(
                F.col("dist") > F.lit(eps)
            ).select("pid", "dist"),
            "noise",
        )
        top = gap.agg(F.max("dist")).first()[0]
        scores = flagged.select("pid").join(gap, "pid", "left").select(
            "pid", F.coalesce(F.col("dist") / F.lit(top or 1.0), F.lit(0.0)).alias("raw")
        )
        return points.spread(scores).select("row_id", "raw")


    def labels(self, frame: Frame) -> DataFrame:
        """Cluster number per row in order of each cluster's first core row; -1 is noise.

        A border row joins the cluster of its nearest core point.
        """
        scaled = unit_scaled(frame)
        eps, need, d = self.options["eps"], self.options["min_samples"], len(frame.features)
        points = distinct_points(scaled.df, scaled.vector(), keep=need)
        flagged = materialise(core_points(points, d, eps, need), "core")
        cells = F.transform("v", lambda x: F.floor(x / F.lit(_cell_side(eps, d))))
        cores = flagged.where("core").select("pid", "v", "ids", cells.alias("_cell"))
        # core points of one cell are always connected, so a cell is one node
        nodes = cores.groupBy("_cell").agg(F.min("pid").alias("node"))
        n_cores = cores.count()
        cores = materialise(join_unique(cores, nodes, "_cell", n_cores).drop("_cell"), "core-nodes")
        roots = materialise(linked_cells(cores, n_cores, eps), "cell-roots")
        placed = materialise(join_unique(cores, roots, "node", n_cores).select("pid", "v", "ids", "root"), "core-roots")
        firsts = placed.groupBy("root").agg(F.min("pid").alias("first"))
        numbers, _ = number_rows(firsts, ["first"], pos="cluster")
        near = knn_points(
            flagged.where(~F.col("core")).select("pid", "v"), placed.select("pid", "v", "ids"), n_cores, 1, radius=eps
        )
        border = near.select("pid", F.col("nbr")).join(placed.select(F.col("pid").alias("nbr"), "root"), "nbr")
        known = placed.select("pid", "root").unionByName(border.select("pid", "root"))
        known = known.join(numbers.select("root", "cluster"), "root")
        per_point = flagged.select("pid").join(known, "pid", "left")
        return points.spread(per_point).select(
            "row_id", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster")
        )


# ---------------------------------------------------------------- Gaussian mixture


_EPSILON = float(np.finfo(float).eps)


def expectation_maximisation(packed: DataFrame, weights, means, covs, max_iter: int, tolerance: float = 0.01):
    """The rounds of Spark's ``GaussianMixture`` from the given start; a round is one fold over the packed rows.

    Same densities (on the span of the covariance), same floor, same end: rounds stop once the log-likelihood
    moves by at most ``tolerance``.  Products of whole chunks take the place of a few vector calls per row.
    """
    k, d = means.shape
    last = math.inf
    for _ in range(max_iter):
        forms = []
        for weight, mean, cov in zip(weights, means, covs):
            values, axes = np.linalg.eigh(cov)
            kept = values > _EPSILON * values.max() * d
            level = -0.5 * (d * math.log(2 * math.pi) + np.log(values[kept]).sum())
            forms.append((weight, mean, axes[:, kept] / np.sqrt(values[kept]), level))

        def expect(x, forms=forms):
            # a row per feature; moments about the means so far, which lose no digits
            about = [x.T - m[:, None] for _, m, _, _ in forms]
            share = np.stack(
                [_EPSILON + w * np.exp(level - 0.5 * ((root.T @ y) ** 2).sum(0)) for y, (w, _, root, level) in zip(about, forms)]
            )
            total = share.sum(0)
            share /= total
            return np.concatenate([
                [np.log(total).sum()], share.sum(1), *[y @ s for y, s in zip(about, share)],
                *[((y * s) @ y.T).ravel() for y, s in zip(about, share)],
            ])

        sums = fold_rows(packed, expect, 1 + k * (1 + d + d * d))
        likelihood, mass = sums[0], sums[1 : 1 + k]
        moved = sums[1 + k : 1 + k + k * d].reshape(k, d) / mass[:, None]
        square = sums[1 + k + k * d :].reshape(k, d, d) / mass[:, None, None]
        weights, means = mass / mass.sum(), means + moved
        covs = square - moved[:, :, None] * moved[:, None, :]
        if abs(likelihood - last) <= tolerance:
            break
        last = likelihood
    return weights, means, covs


class GaussianMixtureDetector(Detector):
    """Negative log-likelihood under a full-covariance mixture."""

    name = "gaussian_mixture"
    defaults = {"n_components": 2, "random_state": 42, "max_iter": 100, "contamination": 0.1}
    normaliser = (0.05, 0.95)

    def raw_scores(self, frame: Frame) -> DataFrame:
        scaled = unit_scaled(frame)
        d = len(scaled.features)
        data = materialise(scaled.df.select("row_id", scaled.vector().alias("v")), "mixture")
        start = GaussianMixture(k=self.options["n_components"], seed=self.options["random_state"], maxIter=0)
        model = start.fit(data.select(array_to_vector("v").alias("features")))
        held = model.gaussiansDF.collect()  # k rows
        weights, means, covs = expectation_maximisation(
            packed_rows(data), np.array(model.weights), np.stack([r["mean"].toArray() for r in held]),
            np.stack([r["cov"].toArray() for r in held]), self.options["max_iter"],
        )
        parts = []
        for weight, mean, cov in zip(weights, means, covs):
            factor = np.linalg.cholesky(cov + 1e-6 * np.eye(d))
            level = math.log(max(weight, 1e-300)) - np.log(np.diag(factor)).sum() - d / 2 * math.log(2 * math.pi)
            parts.append((mean, factor, level))

        def negative_log_likelihood(x: np.ndarray) -> np.ndarray:
            logs = np.stack(
                [lv - 0.5 * (np.linalg.solve(f, (x - m).T) ** 2).sum(0) for m, f, lv in parts]
            )
            top = logs.max(0)
            return -(top + np.log(np.exp(logs - top).sum(0)))

        return data.select("row_id", array_score(F.col("v"), negative_log_likelihood).alias("raw"))
