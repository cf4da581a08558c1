"""Tables behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evaluate import SUMMARY_METRICS, equal_bin
from tidemark.operators.linalg import fit_pca

# fixed values: bins of the charts
GRID_CELLS, HISTOGRAM_BINS = 50, 30
GOOD, FAIR = 0.8, 0.6

MOST_CELLS = 200  # per side of a surface, which bounds the representatives that every task holds
NEAR = 1e-6  # squared distance to a representative, in steps of the grid, that counts as none
THIN = 1e-9  # representatives with less spread across than this, relative to along, lie on a line


def _flag(threshold):
    return (F.col("score") > F.lit(threshold)).alias("is_anomaly")


def score_series(scores: DataFrame, models: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Scores of the named models over time."""
    shown = scores.where(F.col("model").isin(*models))
    return shown.select("model", "row_id", "ts", "score", F.lit(threshold).alias("threshold"), _flag(threshold))


def feature_series(frame_df: DataFrame, features: Sequence[str], scores: DataFrame, model: str,
                   threshold: float = 0.5, ts: str = "ts") -> DataFrame:
    """The named features over time with the flags of one model."""
    mine = scores.where(F.col("model") == model).select("row_id", "score")
    return (
        frame_df.join(mine, "row_id")
        .select("row_id", ts, *features, _flag(threshold))
        .unpivot(["row_id", ts, "is_anomaly"], list(features), "feature", "value")
    )


def performance_bands(summary: DataFrame) -> DataFrame:
    """model x metric with a colour band; a missing metric counts as 0."""
    long = summary.unpivot(["model"], list(SUMMARY_METRICS), "metric", "value")
    value = F.coalesce("value", F.lit(0.0))
    band = F.when(value >= GOOD, "good").when(value >= FAIR, "fair").otherwise("poor")
    return long.select("model", "metric", value.alias("value"), band.alias("band"))


def projection(frame_df: DataFrame, features: Sequence[str], scores: DataFrame, model: str,
               threshold: float = 0.5) -> DataFrame:
    """Two-dimensional view: principal components, or the features themselves if there are two."""
    mine = scores.where(F.col("model") == model).select("row_id", "score")
    if len(features) > 2:
        flat = fit_pca(frame_df, features, 2).transform(frame_df).select(
            "row_id", F.col("PC_1").alias("x"), F.col("PC_2").alias("y")
        )
    else:
        flat = frame_df.select("row_id", *[F.col(c).cast("double").alias(a) for c, a in zip(features, "xy")])
    return flat.join(mine, "row_id").select("row_id", "x", "y", "score", _flag(threshold))


def score_grid(points: DataFrame, cells: int = GRID_CELLS) -> DataFrame:
    """Mean score per cell of a square grid over the projected points."""
    r = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if r["x0"] is None:
        return points.select(F.lit(0).alias("cx"), F.lit(0).alias("cy"), F.lit(0.0).alias("mean_score")).limit(0)

    def cell(c, lo, hi):
        return equal_bin(F.col(c), lo, hi, cells) if hi > lo else F.lit(0)

    return points.groupBy(cell("x", r["x0"], r["x1"]).alias("cx"), cell("y", r["y0"], r["y1"]).alias("cy")).agg(
        F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("points")
    )


def score_surface(points: DataFrame, cells: int = GRID_CELLS) -> DataFrame:
    """Interpolated score at every node of a grid from corner to corner of the points: gx, gy, x, y, score.

    Points are first folded into one representative per cell (mean place, mean score; at most cells x cells, the
    only data that leaves the cluster).  A node takes the value there of the plane that fits the representatives
    best, each weighted by 1 / distance^4: planes come out exactly, and near a representative the surface runs
    through its score.  Where the representatives lie on a line, the node takes their weighted mean.  Values are
    cut to the range of scores, 0 to 1.  Points without a place or score are ignored; without any there are no rows.
    """
    if not 2 <= cells <= MOST_CELLS:
        raise ValueError(f"a surface has 2 to {MOST_CELLS} nodes per side, not {cells}")
    shown = points.select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "score")]).where(
        " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("x", "y", "score"))
    )
    ends = shown.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    x0, x1, y0, y1 = ends
    schema = "gx int, gy int, x double, y double, score double"
    if x0 is None:
        return points.sparkSession.createDataFrame([], schema)

    def steps(c, lo, hi):
        return (F.col(c) - F.lit(lo)) / F.lit((hi - lo) / (cells - 1)) if hi > lo else F.lit(0.0)

    placed = shown.select(steps("x", x0, x1).alias("u"), steps("y", y0, y1).alias("v"), "score")
    cell = [F.least(F.floor(F.col(c) * F.lit(cells / (cells - 1))), F.lit(cells - 1)) for c in "uv"]
    held = placed.groupBy(*cell).agg(*[F.avg(c).alias(c) for c in ("u", "v", "score")]).select("u", "v", "score").toPandas()
    u, v, score = (held[c].to_numpy() for c in ("u", "v", "score"))

    def fitted(gx, gy):
        du, dv = u - gx[:, None], v - gy[:, None]
        w = 1.0 / np.maximum(du * du + dv * dv, NEAR) ** 2
        w /= w.sum(axis=1, keepdims=True)
        mean = lambda a: (w * a).sum(axis=1)
        mu, mv, ms = mean(du), mean(dv), mean(score)
        uu, vv, uv = mean(du * du) - mu * mu, mean(dv * dv) - mv * mv, mean(du * dv) - mu * mv
        us, vs = mean(du * score) - mu * ms, mean(dv * score) - mv * ms
        det = uu * vv - uv * uv
        flat = det <= THIN * (uu + vv) ** 2
        safe = np.where(flat, 1.0, det)
        slope_u, slope_v = (us * vv - vs * uv) / safe, (vs * uu - us * uv) / safe
        return np.clip(np.where(flat, ms, ms - slope_u * mu - slope_v * mv), 0.0, 1.0)

    def nodes(batches):
        for batch in batches:
            gx, gy = np.divmod(batch["id"].to_numpy(), cells)
            lots = range(0, len(gx), 256)
            values = [fitted(gx[k: k + 256].astype(float), gy[k: k + 256].astype(float)) for k in lots]
            yield pd.DataFrame({
                "gx": gx, "gy": gy, "x": x0 + gx * ((x1 - x0) / (cells - 1)), "y": y0 + gy * ((y1 - y0) / (cells - 1)),
                "score": np.concatenate(values) if values else np.zeros(0),
            })

    return points.sparkSession.range(cells * cells).mapInPandas(nodes, schema)


def score_histogram(scores: DataFrame, models: Sequence[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal bins between each model's smallest and largest score."""
    shown = scores.where(F.col("model").isin(*models))
    ends = {r["model"]: (r["lo"], r["hi"]) for r in
            shown.groupBy("model").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()}
    index = F.lit(0)
    for m, (lo, hi) in ends.items():
        if hi > lo:
            index = F.when(F.col("model") == m, equal_bin(F.col("score"), lo, hi, bins)).otherwise(index)
    return shown.groupBy("model", index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("frequency"))


def anomaly_counts(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Normal and anomalous rows per model, with percentages."""
    hit = F.count_if(F.col("score") > F.lit(threshold))
    total = F.count(F.lit(1))
    wide = scores.groupBy("model").agg(hit.alias("anomaly"), (total - hit).alias("normal"))
    both = F.col("anomaly") + F.col("normal")
    return wide.withColumn("_total", both).unpivot(
        ["model", "_total"], ["normal", "anomaly"], "kind", "rows"
    ).select("model", "kind", "rows", (F.col("rows") * 100.0 / F.col("_total")).alias("percentage"))


def scatter_points(frame_df: DataFrame, features: Sequence[str], scores: DataFrame, model: str) -> DataFrame:
    """The named features with the score of one model."""
    mine = scores.where(F.col("model") == model).select("row_id", "score")
    return frame_df.select("row_id", *features).join(mine, "row_id")
