"""Evaluation of scores, with and without labels.

Input tables hold ``row_id`` (0-based position), ``score``, and where needed
``ts`` and a 0/1 ``label``.  Every function returns one row of metrics.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import flag
from tidemark.operators.order import prefix_sums
from tidemark.operators.quantile import quantiles
from tidemark.operators.runs import episodes, gaps, run_ids, with_previous

SUMMARY_METRICS = ("auc_roc", "f1_score", "precision", "recall")
ENTROPY_BINS = 19  # 20 edges
SIGMA_RULE = 2.0


def basic_stats(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    mid = quantiles(df, ["score"], [0.5])["score"][0]
    hit = F.col("score") > F.lit(threshold)
    return df.agg(
        F.count("score").alias("total_samples"),
        F.count_if(hit).alias("anomalies_detected"),
        F.avg(hit.cast("double")).alias("anomaly_rate"),
        F.avg("score").alias("mean_anomaly_score"),
        F.stddev_pop("score").alias("std_anomaly_score"),
        F.min("score").alias("min_anomaly_score"),
        F.max("score").alias("max_anomaly_score"),
    ).withColumns(
        {"median_anomaly_score": F.lit(mid).cast("double"), "threshold_used": F.lit(float(threshold))}
    )


def _ratio(top, bottom):
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def confusion(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts at the threshold and the rates made of them; 0 where undefined."""
    p, y = flag(F.col("score"), threshold) == 1, F.col("label") == 1
    counts = df.agg(
        F.count_if(p & y).alias("true_positives"),
        F.count_if(p & ~y).alias("false_positives"),
        F.count_if(~p & ~y).alias("true_negatives"),
        F.count_if(~p & y).alias("false_negatives"),
    )
    tp, fp, tn, fn = (
        F.col(c) for c in ("true_positives", "false_positives", "true_negatives", "false_negatives")
    )
    return counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
            "specificity": _ratio(tn, tn + fp),
        }
    )


def curve_points(df: DataFrame) -> DataFrame:
    """One row per distinct score with the positives and negatives at or below it."""
    per_score = df.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    return prefix_sums(per_score, ["score"], {"pos_upto": "pos", "neg_upto": "neg"})


def curve_metrics(df: DataFrame) -> DataFrame:
    """ROC area (ties count half), average precision, and the PR trapezoid.

    Without both classes the areas are 0.
    """
    points = curve_points(df)
    totals = points.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    # doubles: the product of two integer counts overflows from some 50 000 rows of each class on
    p, n = F.lit(float(totals["p"] or 0)), F.lit(float(totals["n"] or 0))
    below_pos, below_neg = F.col("pos_upto") - F.col("pos"), F.col("neg_upto") - F.col("neg")
    tp, fp = p - below_pos, n - below_neg  # rows at or above this score
    tp_up, fp_up = p - F.col("pos_upto"), n - F.col("neg_upto")  # rows above it
    precision = tp / (tp + fp)
    precision_up = F.when(tp_up + fp_up > 0, tp_up / (tp_up + fp_up)).otherwise(F.lit(1.0))
    step = F.col("pos") / p
    if not totals["p"]:
        return points.agg(*[F.lit(0.0).alias(c) for c in ("auc_roc", "auc_pr", "pr_auc_trapz", "vus_pr")])
    areas = points.agg(
        F.sum(F.col("pos") * (below_neg + F.col("neg") / 2)).alias("_wins"),
        F.sum(step * precision).alias("auc_pr"),
        F.sum(step * (precision + precision_up) / 2).alias("pr_auc_trapz"),
    )
    roc = F.col("_wins") / (p * n) if totals["n"] else F.lit(0.0)
    return areas.select(
        roc.alias("auc_roc"), "auc_pr", "pr_auc_trapz", (F.col("pr_auc_trapz") / p).alias("vus_pr")
    )


def supervised(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return _side_by_side(confusion(df, threshold), curve_metrics(df))


def distribution(df: DataFrame) -> DataFrame:
    """Variance, entropy, isolation score, skewness and excess kurtosis of the scores."""
    q25, q75 = quantiles(df, ["score"], [0.25, 0.75])["score"]
    fence = (q75 + 1.5 * (q75 - q25)) if q75 is not None else None
    shape = df.agg(
        F.var_pop("score").alias("score_variance"),
        F.coalesce(F.avg((F.col("score") > F.lit(fence)).cast("double")), F.lit(0.0)).alias("isolation_score"),
        _moment(F.skewness("score")).alias("score_skewness"),
        _moment(F.kurtosis("score")).alias("score_kurtosis"),
    )
    return _side_by_side(shape, entropy(df))


def _moment(c):
    return F.when(F.stddev_pop("score") > 0, c).otherwise(F.lit(0.0))


def entropy(df: DataFrame) -> DataFrame:
    """Shannon entropy (bits) of the scores in equal bins between minimum and maximum."""
    lo, hi = df.agg(F.min("score"), F.max("score")).first()
    if lo is None or hi == lo:
        return df.agg(F.lit(0.0).alias("score_entropy"))
    bins = df.groupBy(equal_bin(F.col("score"), lo, hi, ENTROPY_BINS).alias("bin")).agg(
        F.count(F.lit(1)).alias("c")
    )
    # -sum p log2 p with p = c / N
    total = F.sum("c")
    return bins.agg(
        (F.log2(total.cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / total).alias(
            "score_entropy"
        )
    )


def equal_bin(c, lo: float, hi: float, bins: int):
    """Index of the equal-width bin, the last one closed."""
    width = (hi - lo) / bins
    return F.least(F.floor((c - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")


def consistency(df: DataFrame, n: int, threshold: float = 0.5) -> DataFrame:
    """1 - changes of the prediction per step."""
    pred = df.select("row_id", flag(F.col("score"), threshold).alias("pred"))
    held = with_previous(pred, n, {"_prev": "pred"})
    changes = F.count_if(F.col("pred") != F.col("_prev"))
    steps = F.count("_prev")
    return held.agg(
        F.when(steps > 0, 1.0 - changes / steps).otherwise(F.lit(1.0)).alias("prediction_consistency")
    )


def synthetic(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and AUC against labels made by the two-sigma rule."""
    names = {"precision": "synthetic_precision", "recall": "synthetic_recall",
             "f1_score": "synthetic_f1", "auc_roc": "synthetic_auc"}
    mean, sd = df.agg(F.avg("score"), F.stddev_pop("score")).first()
    if not sd:
        return df.agg(*[F.lit(0.0).alias(c) for c in names.values()])
    z = F.abs((F.col("score") - F.lit(mean)) / F.lit(sd))
    labelled = df.withColumn("label", (z > F.lit(SIGMA_RULE)).cast("int"))
    both = labelled.agg(F.min("label"), F.max("label")).first()
    if both[0] == both[1]:
        return df.agg(*[F.lit(0.0).alias(c) for c in names.values()])
    return supervised(labelled, threshold).select(*[F.col(a).alias(b) for a, b in names.items()])


def temporal(df: DataFrame, n: int, threshold: float = 0.5) -> DataFrame:
    """Gaps between anomalies, episode durations and temporal spread (NULL when undefined)."""
    flagged = df.select("row_id", "ts", flag(F.col("score"), threshold).alias("pred"))
    between = gaps(flagged, n).agg(
        F.avg("seconds").alias("avg_time_between_anomalies"),
        F.min("seconds").alias("min_time_between_anomalies"),
        F.max("seconds").alias("max_time_between_anomalies"),
    )
    lasting = episodes(flagged, n).agg(
        F.avg("seconds").alias("avg_anomaly_duration"),
        F.max("seconds").alias("max_anomaly_duration"),
        F.min("seconds").alias("min_anomaly_duration"),
        F.count(F.lit(1)).alias("num_anomaly_episodes"),
    )
    return _side_by_side(between, lasting, spread(flagged, n))


def spread(flagged: DataFrame, n: int) -> DataFrame:
    at = F.when(F.col("pred") == 1, F.col("row_id"))
    return flagged.agg(
        F.when(F.count(at) == 0, F.lit(None))
        .when(F.count(at) > 1, (F.max(at) - F.min(at)) / F.lit(max(n - 1, 1)))
        .otherwise(F.lit(0.0))
        .cast("double")
        .alias("anomaly_temporal_spread")
    )


def event_f1(df: DataFrame, n: int, threshold: float = 0.5) -> DataFrame:
    """F1 over runs: a true run counts as found, a predicted run as right, if they touch."""
    flagged = df.select("row_id", "label", flag(F.col("score"), threshold).alias("pred"))
    runs = run_ids(flagged, n, {"true_run": "label", "pred_run": "pred"})
    per_true = runs.where("true_run is not null").groupBy("true_run").agg(F.max("pred").alias("hit"))
    per_pred = runs.where("pred_run is not null").groupBy("pred_run").agg(F.max("label").alias("hit"))
    found = per_true.agg(F.count(F.lit(1)).alias("true_events"), F.count_if(F.col("hit") == 1).alias("_found"))
    right = per_pred.agg(F.count(F.lit(1)).alias("pred_events"), F.count_if(F.col("hit") == 1).alias("_right"))
    both = _side_by_side(found, right).withColumns(
        {
            "event_recall": _ratio(F.col("_found"), F.col("true_events")),
            "event_precision": _ratio(F.col("_right"), F.col("pred_events")),
        }
    )
    p, r = F.col("event_precision"), F.col("event_recall")
    return both.withColumn("event_f1", _ratio(2 * p * r, p + r)).drop("_found", "_right")


def evaluate(
    df: DataFrame, n: int, threshold: float = 0.5, labelled: bool = False, timed: bool = False
) -> DataFrame:
    """All metrics that apply, as (metric, value) rows."""
    parts = [basic_stats(df, threshold)]
    if labelled:
        parts += [supervised(df, threshold), event_f1(df, n, threshold)]
    else:
        parts += [distribution(df), consistency(df, n, threshold), synthetic(df, threshold)]
    if timed:
        parts.append(temporal(df, n, threshold))
    return functools.reduce(DataFrame.unionByName, [_long(p) for p in parts])


def _long(row: DataFrame) -> DataFrame:
    wide = row.select(*[F.col(c).cast("double").alias(c) for c in row.columns])
    return wide.unpivot([], list(wide.columns), "metric", "value").where(F.col("value").isNotNull())


def _side_by_side(*rows: DataFrame) -> DataFrame:
    """One row with the columns of several one-row tables."""
    names = [c for r in rows for c in r.columns]
    stacked = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


COUNTS = ("total_samples", "anomalies_detected", "num_anomaly_episodes")


def summary_text(metrics: dict[str, float]) -> str:
    """Readable selection of metrics: counts in full, the rest to four digits."""
    groups = {
        "overall": ("total_samples", "anomalies_detected", "anomaly_rate"),
        "with labels": ("auc_roc", "auc_pr", "f1_score", "precision", "recall"),
        "without labels": ("synthetic_f1", "isolation_score", "prediction_consistency"),
        "over time": ("num_anomaly_episodes", "avg_anomaly_duration"),
    }
    lines = []
    for title, names in groups.items():
        known = [f"  {m}: {metrics[m]:{'.0f' if m in COUNTS else '.4g'}}" for m in names if metrics.get(m) is not None]
        if known:
            lines += [title, *known]
    return "\n".join(lines)
