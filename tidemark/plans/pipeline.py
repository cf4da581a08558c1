"""The end-to-end job: features, detectors, scores, metrics, summary."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.detectors import registry
from tidemark.detectors.per_series import raw_scores_by
from tidemark.frame import Frame
from tidemark.operators.evaluate_groups import evaluate_by
from tidemark.operators.features import engineer, feature_columns
from tidemark.operators.impute import impute, impute_by
from tidemark.operators.linalg import Pca, fit_pca
from tidemark.operators.order import number_rows
from tidemark.operators.normalise import minmax_by, quantile_clip_by
from tidemark.operators.scale import scale, scale_by
from tidemark.operators.segments import segment
from tidemark.plans.selection import select_models
from tidemark.session import materialise
from tidemark.sources.readers import TIMESTAMP_NAMES, detect_timestamp, nan_to_null, read_events
from tidemark.sources.sinks import summary_table, write_scores, write_summary

# fixed values: default preprocessing options
PREPROCESSING = {
    "missing_strategy": "mean",
    "scaling_method": "standard",
    "feature_engineering": True,
    "add_statistical_features": True,
    "add_interaction_features": False,
    "interaction_columns": None,
    "rolling_window": 10,
    "apply_pca": False,
    "pca_components": 0.95,
}


@dataclass(frozen=True)
class Prepared:
    frame: Frame
    summary: dict[str, Any]
    pca: Pca | None = None
    label: str | None = None


@dataclass(frozen=True)
class Detection:
    scores: DataFrame  # row_id, ts, model, score
    metrics: DataFrame  # model, metric, value
    summary: DataFrame  # one row per model
    audit: DataFrame  # one row per model that was tried


def prepare(
    df: DataFrame,
    order_by: Sequence[str] | None = None,
    ts: str | None = None,
    features: Sequence[str] | None = None,
    label_col: str | None = None,
    **options,
) -> Prepared:
    """Impute, engineer, scale and optionally reduce; rows keep one position throughout."""
    unknown = set(options) - set(PREPROCESSING)
    if unknown:
        raise ValueError(f"unknown preprocessing options {sorted(unknown)}")
    o = {**PREPROCESSING, **options}
    ts = ts or detect_timestamp(df, TIMESTAMP_NAMES[:5])
    cols = list(features or [c for c in feature_columns(df, ts) if c != label_col])
    if not cols:
        raise ValueError("no numeric feature columns")
    # the position must not depend on partitioning, so without a given order every column counts
    order = list(order_by or [*([ts] if ts else []), *[c for c in df.columns if c != ts]])
    types = {f.name: f.dataType for f in df.schema}
    keep = list(dict.fromkeys([*order, *([ts] if ts else []), *([label_col] if label_col else []), *cols]))
    rows = nan_to_null(df.select(*keep))
    if o["missing_strategy"] == "drop":
        rows = impute(rows, cols, "drop")
    rows, n = number_rows(rows, order)
    if ts and ts not in cols:
        rows = rows.withColumn("_ts", F.col(ts).cast("timestamp"))
    carried = [c for c in ("_ts",) if ts and ts not in cols]
    rows = rows.select("row_id", *carried, *([F.col(label_col).alias("_label")] if label_col else []), *cols)
    carried += ["_label"] if label_col else []
    if o["missing_strategy"] != "drop":
        rows = impute(rows, cols, o["missing_strategy"])
    names = cols
    if o["feature_engineering"]:
        rows, names = engineer(
            rows, cols, n, "_ts" if "_ts" in carried else None, types,
            o["rolling_window"], o["add_statistical_features"], o["add_interaction_features"],
            interaction_columns=o["interaction_columns"],
        )
    # statistics and values read the same written table
    rows = scale(materialise(rows.select("row_id", *carried, *names), "features"), names, o["scaling_method"])
    pca = None
    if o["apply_pca"]:
        pca = fit_pca(rows, names, o["pca_components"])
        names = [f"PC_{i + 1}" for i in range(pca.k)]
        rows = pca.transform(rows).select("row_id", *carried, *names)
    frame = Frame(materialise(rows, "prepared"), tuple(names), n, "_ts" if "_ts" in carried else None)
    return Prepared(frame, preprocessing_summary(cols, ts, o, pca), pca, "_label" if label_col else None)


def preprocessing_summary(cols, ts, options, pca: Pca | None) -> dict[str, Any]:
    out = {
        "feature_columns": list(cols),
        "timestamp_column": ts,
        "scaling_method": options["scaling_method"],
        "missing_strategy": options["missing_strategy"],
        "feature_engineering": options["feature_engineering"],
        "pca_applied": pca is not None,
    }
    if pca is not None:
        out |= {"pca_components": pca.k, "explained_variance": pca.explained}
    return out


class ModelsFailed(RuntimeError):
    """Models without scores; ``audit`` has a tuple (model, status, message, rows, features) for each that was tried."""

    def __init__(self, audit: list[tuple]):
        failed = [(a[0], a[2]) for a in audit if a[1] == "failed"]
        super().__init__(f"{'all' if len(failed) == len(audit) else len(failed)} models failed: {failed}")
        self.audit = audit


def run_models(
    frame: Frame, models: Sequence[str], options: dict[str, dict] | None = None, skip_failed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Scores of every model (row_id, model, score) and the run audit.

    A failing model raises once all have run, so that scores without it are not taken for the whole result.  Who
    reads the audit may ask with ``skip_failed`` to have it recorded there instead; if all fail, that raises too.
    Unknown names raise before any work.
    """
    spark = frame.df.sparkSession
    detectors = [registry.create(m, **(options or {}).get(m, {})) for m in models]
    tables, audit = [], []
    for name, detector in zip(models, detectors):
        try:
            scored = materialise(detector.fit_predict(frame), f"scores-{name}")
            tables.append(scored.withColumn("model", F.lit(name)).select("row_id", "model", "score"))
            audit.append((name, "ok", None, frame.n, len(frame.features)))
        except Exception as e:  # noqa: BLE001 - recorded, and the other models still run
            audit.append((name, "failed", str(e), frame.n, len(frame.features)))
    if not tables or not skip_failed and any(a[1] == "failed" for a in audit):
        raise ModelsFailed(audit)
    audit_df = spark.createDataFrame(
        audit, "model string, status string, message string, rows bigint, features int"
    )
    return functools.reduce(DataFrame.unionByName, tables), audit_df


def metrics_of(scores: DataFrame, models: Sequence[str], n: int, threshold: float, labelled: bool, timed: bool) -> DataFrame:
    """(model, metric, value) for every model, all of them in one set of jobs."""
    return evaluate_by(scores.where(F.col("model").isin(*models)), ["model"], threshold, labelled, timed)


def detect(
    df: DataFrame,
    order_by: Sequence[str] | None = None,
    features: Sequence[str] | None = None,
    models: Sequence[str] | None = None,
    auto_select: bool = False,
    label_col: str | None = None,
    ts: str | None = None,
    threshold: float = 0.5,
    model_options: dict[str, dict] | None = None,
    selection: dict[str, Any] | None = None,
    output: str | None = None,
    export_format: str = "both",
    skip_failed: bool = True,
    **preprocessing,
) -> Detection:
    """Named models, else automatically selected ones, else all registered ones.

    A failing model is recorded in the audit; without ``skip_failed`` it raises.
    """
    if export_format not in ("json", "csv", "both"):
        raise ValueError(f"unknown export_format {export_format}")
    prepared = prepare(df, order_by, ts, features, label_col, **preprocessing)
    frame = prepared.frame
    if models:
        chosen = list(models)
    elif auto_select:
        chosen = select_models(frame, **(selection or {}))
    else:
        chosen = registry.names()
    scores, audit = run_models(frame, chosen, model_options, skip_failed)
    timed = frame.ts is not None
    side = frame.df.select(
        "row_id",
        (F.col("_ts") if timed else F.lit(None).cast("timestamp")).alias("ts"),
        *([F.col("_label").cast("int").alias("label")] if label_col else []),
    )
    scores = materialise(scores.join(side, "row_id"), "scores")
    done = [r["model"] for r in audit.where("status = 'ok'").collect()]
    metrics = materialise(
        metrics_of(scores, done, frame.n, threshold, label_col is not None, timed), "metrics"
    )
    result = Detection(
        scores.select("row_id", "ts", "model", "score"), metrics, summary_table(scores, metrics), audit
    )
    if output:
        if export_format in ("json", "both"):
            write_scores(result.scores, f"{output}/scores")
            metrics.write.json(f"{output}/metrics")
        if export_format in ("csv", "both"):
            write_summary(result.summary, f"{output}/summary")
    return result


@dataclass(frozen=True)
class SeriesDetection:
    scores: DataFrame  # series..., row_id, ts, model, score
    metrics: DataFrame  # series..., model, metric, value


def detect_series(
    df: DataFrame,
    series: Sequence[str],
    order_by: Sequence[str],
    features: Sequence[str],
    models: Sequence[str] = ("pca",),
    label_col: str | None = None,
    ts: str | None = None,
    threshold: float = 0.5,
    model_options: dict[str, dict] | None = None,
    missing_strategy: str = "mean",
    scaling_method: str | None = None,
    feature_engineering: bool = False,
) -> SeriesDetection:
    """A run for every series, each with its own order, statistics, models and metrics, as one plan.

    The work and the number of jobs do not depend on the number of series, and a series may hold most of the
    rows.  Models are those of ``detectors/per_series.py``.
    """
    series, cols = list(series), list(features)
    keep = list(dict.fromkeys([*series, *order_by, *([ts] if ts else []), *([label_col] if label_col else []), *cols]))
    rows = impute_by(nan_to_null(df.select(*keep)), cols, series, missing_strategy)
    rows, n = number_rows(rows, list(order_by), series=series)
    side = [*([F.col(ts).cast("timestamp").alias("ts")] if ts else []), *([F.col(label_col).cast("int").alias("label")] if label_col else [])]
    named = [c.alias(f"_{k}") for k, c in enumerate(side)]
    rows = rows.select(*series, "row_id", *named, *cols)
    if feature_engineering:
        rows, cols = engineer(rows, cols, n, "_0" if ts else None, series=series)
    if scaling_method:
        rows = scale_by(materialise(rows, "features"), cols, series, scaling_method)
    segments = segment(rows, series)
    tables = []
    for name in models:
        raw = materialise(raw_scores_by(segments, cols, name, (model_options or {}).get(name)), f"raw-{name}")
        rule = registry.entry(name).detector.normaliser
        scored = quantile_clip_by(raw, ["_g"], *rule) if isinstance(rule, tuple) else minmax_by(raw, ["_g"])
        tables.append(scored.select("_g", "row_id", F.lit(name).alias("model"), "score"))
    told = segments.df.select("_g", "row_id", *series, *[F.col(f"_{k}").alias(name) for k, name in enumerate([*(["ts"] if ts else []), *(["label"] if label_col else [])])])
    scores = functools.reduce(DataFrame.unionByName, tables).join(told, ["_g", "row_id"]).drop("_g")
    scores = materialise(scores, "series-scores")
    metrics = evaluate_by(scores, [*series, "model"], threshold, label_col is not None, ts is not None)
    return SeriesDetection(scores, metrics)


def detect_files(spark: SparkSession, paths: Sequence[str], kind: str | None = None, fmt: str | None = None,
                 schema=None, **options) -> dict[str, Detection]:
    """Independent runs, one per file: own statistics, own model, own results."""
    return {p: detect(read_events(spark, p, kind, fmt, schema), **options) for p in paths}
