"""Evaluation metrics on events: score = min-max of the value, label = error events."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import LINES_SQL, SCORED_SQL, SQL, THRESHOLD, lines, query, r, scored_events, table
from catalog.series import EPISODES_SQL, RUNS_SQL
from tidemark.functions.scalars import flag
from tidemark.operators import evaluate, runs
from tidemark.operators.normalise import minmax
from tidemark.session import materialise

T = THRESHOLD


def rounded(df, digits=6):
    return df.select(*[r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("basic_statistics", f"""WITH {SCORED_SQL}
SELECT count(*) AS total_samples, count(*) FILTER (score > {T}) AS anomalies_detected,
  round(avg(CAST(score > {T} AS INTEGER)), 6) AS anomaly_rate, round(avg(score), 6) AS mean_anomaly_score,
  round(stddev_pop(score), 6) AS std_anomaly_score, round(min(score), 6) AS min_anomaly_score,
  round(max(score), 6) AS max_anomaly_score, round(median(score), 6) AS median_anomaly_score,
  CAST({T} AS DOUBLE) AS threshold_used FROM ev""")
def basic_statistics(spark, sf):
    return rounded(evaluate.basic_stats(scored_events(spark, sf)[0], T))


CONFUSION_SQL = f"""cf AS (SELECT count(*) FILTER (score > {T} AND label = 1) AS tp, count(*) FILTER (score > {T} AND label = 0) AS fp,
  count(*) FILTER (score <= {T} AND label = 0) AS tn, count(*) FILTER (score <= {T} AND label = 1) AS fn FROM lab)"""


def _div(a, b):
    return f"round(CASE WHEN {b} > 0 THEN 1.0 * ({a}) / ({b}) ELSE 0 END, 6)"


CONFUSION_COLUMNS = f"""tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives,
  {_div('tp + tn', '(tp + fp + tn + fn)')} AS accuracy, {_div('tp', '(tp + fp)')} AS precision,
  {_div('tp', '(tp + fn)')} AS recall, {_div('2 * tp', '(2 * tp + fp + fn)')} AS f1_score,
  {_div('tn', '(tn + fp)')} AS specificity"""


@query("confusion_metrics", f"WITH {SCORED_SQL}, lab AS (SELECT * FROM ev), {CONFUSION_SQL} SELECT {CONFUSION_COLUMNS} FROM cf")
def confusion_metrics(spark, sf):
    return rounded(evaluate.confusion(scored_events(spark, sf)[0], T))


CURVE_SQL = """g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM lab GROUP BY 1),
cu AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp,
  sum(p) OVER () AS tot_p, sum(n) OVER () AS tot_n FROM g),
pt AS (SELECT *, tp * 1.0 / (tp + fp) AS prec, coalesce(lag(tp * 1.0 / (tp + fp)) OVER (ORDER BY score DESC), 1.0) AS prec_up FROM cu),
ar AS (SELECT sum(p * ((tot_n - fp) + n / 2.0)) / (max(tot_p) * max(tot_n)) AS auc, sum(p * prec / tot_p) AS ap,
  sum(p * (prec + prec_up) / 2 / tot_p) AS tz, max(tot_p) AS pos FROM pt)"""


@query("curve_metrics", f"""WITH {SCORED_SQL}, lab AS (SELECT * FROM ev), {CURVE_SQL}
SELECT round(auc, 6) AS auc_roc, round(ap, 6) AS auc_pr, round(tz, 6) AS pr_auc_trapz, round(tz / pos * 1e3, 6) AS vus_pr_1e3 FROM ar""")
def curve_metrics(spark, sf):
    out = evaluate.curve_metrics(scored_events(spark, sf)[0]).withColumn("vus_pr_1e3", F.col("vus_pr") * 1e3)
    return rounded(out.drop("vus_pr"))


@query("curve_points", f"""WITH {SCORED_SQL}, lab AS (SELECT * FROM ev), {CURVE_SQL}
SELECT round(score, 9) AS score, p AS pos, n AS neg, CAST(tot_p - tp + p AS BIGINT) AS pos_upto, CAST(tot_n - fp + n AS BIGINT) AS neg_upto FROM cu""")
def curve_points(spark, sf):
    out = evaluate.curve_points(scored_events(spark, sf)[0])
    return out.select(r("score", 9).alias("score"), "pos", "neg", "pos_upto", "neg_upto")


@query("supervised_rare_labels", f"""
WITH d AS (SELECT doc_id, toxic AS label, 1.0 * n_chars AS c FROM documents JOIN labels USING (doc_id)),
lab AS (SELECT doc_id, label, (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS score FROM d),
{CURVE_SQL}, {CONFUSION_SQL}
SELECT {CONFUSION_COLUMNS}, round(auc, 6) AS auc_roc, round(ap, 6) AS auc_pr, round(tz, 6) AS pr_auc_trapz,
  round(tz / pos, 6) AS vus_pr FROM ar, cf""")
def supervised_rare_labels(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    lab = docs.select("doc_id", F.col("toxic").alias("label"), F.col("n_chars").cast("double").alias("raw"))
    return rounded(evaluate.supervised(materialise(minmax(lab), "toxic"), T))


@query("score_distribution", f"""
WITH {SCORED_SQL}, m AS (SELECT avg(score) AS mu, stddev_pop(score) AS sd, min(score) AS lo, max(score) AS hi,
  quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.75) AS c, count(*) AS n FROM ev),
h AS (SELECT least(floor((score - lo) / ((hi - lo) / 19)), 18) AS b, count(*) * 1.0 / max(n) AS p FROM ev, m GROUP BY 1),
s AS (SELECT avg(pow((score - mu) / sd, 3)) AS sk, avg(pow((score - mu) / sd, 4)) - 3 AS ku,
  avg(CAST(score > c + 1.5 * (c - a) AS INTEGER)) AS iso, var_pop(score) AS va FROM ev, m)
SELECT round(va, 6) AS score_variance, round((SELECT -sum(p * log2(p)) FROM h), 6) AS score_entropy,
  round(iso, 6) AS isolation_score, round(sk, 6) AS score_skewness, round(ku, 6) AS score_kurtosis FROM s""")
def score_distribution(spark, sf):
    return rounded(evaluate.distribution(scored_events(spark, sf)[0]))


@query("prediction_consistency", f"""
WITH {RUNS_SQL}, t AS (SELECT pred <> lag(pred) OVER (ORDER BY row_id) AS ch FROM p)
SELECT round(1 - count(*) FILTER (ch) * 1.0 / count(ch), 6) AS prediction_consistency FROM t""")
def prediction_consistency(spark, sf):
    df, n = scored_events(spark, sf)
    return rounded(evaluate.consistency(df, n, T))


@query("synthetic_metrics", f"""
WITH {SCORED_SQL}, m AS (SELECT avg(score) AS mu, stddev_pop(score) AS sd FROM ev),
lab AS (SELECT score, CAST(abs((score - mu) / sd) > 2 AS INTEGER) AS label FROM ev, m), {CURVE_SQL}, {CONFUSION_SQL}
SELECT {_div('tp', '(tp + fp)')} AS synthetic_precision, {_div('tp', '(tp + fn)')} AS synthetic_recall,
  {_div('2 * tp', '(2 * tp + fp + fn)')} AS synthetic_f1, round(auc, 6) AS synthetic_auc FROM cf, ar""")
def synthetic_metrics(spark, sf):
    return rounded(evaluate.synthetic(scored_events(spark, sf)[0], T))


@query("anomaly_gaps", f"""
WITH {RUNS_SQL}, g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY row_id))) / 1e6 AS s FROM p WHERE pred = 1)
SELECT round(avg(s), 4) AS avg_time_between_anomalies, round(min(s), 5) AS min_time_between_anomalies,
  round(max(s), 5) AS max_time_between_anomalies FROM g""")
def anomaly_gaps(spark, sf):
    df, n = scored_events(spark, sf)
    flagged = df.select("row_id", "ts", flag(F.col("score"), T).alias("pred"))
    return runs.gaps(flagged, n).agg(
        r(F.avg("seconds"), 4).alias("avg_time_between_anomalies"),
        r(F.min("seconds"), 5).alias("min_time_between_anomalies"),
        r(F.max("seconds"), 5).alias("max_time_between_anomalies"),
    )


@query("temporal_metrics", f"""
WITH {EPISODES_SQL}, d AS (SELECT (epoch_us(z) - epoch_us(a)) / 1e6 AS s FROM ep),
g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY row_id))) / 1e6 AS s FROM p WHERE pred = 1)
SELECT (SELECT round(avg(s), 4) FROM g) AS avg_time_between_anomalies, (SELECT round(min(s), 4) FROM g) AS min_time_between_anomalies,
  (SELECT round(max(s), 4) FROM g) AS max_time_between_anomalies, round(avg(s), 4) AS avg_anomaly_duration,
  round(max(s), 4) AS max_anomaly_duration, round(min(s), 4) AS min_anomaly_duration, count(*) AS num_anomaly_episodes,
  (SELECT round((max(row_id) FILTER (pred = 1) - min(row_id) FILTER (pred = 1)) * 1.0 / (count(*) - 1), 4) FROM p) AS anomaly_temporal_spread
FROM d""")
def temporal_metrics(spark, sf):
    df, n = scored_events(spark, sf)
    return rounded(evaluate.temporal(df, n, T), 4)


@query("event_f1", f"""
WITH {RUNS_SQL}, t AS (SELECT lrun, max(pred) AS hit FROM rn WHERE label = 1 GROUP BY 1),
q AS (SELECT run, max(label) AS hit FROM rn WHERE pred = 1 GROUP BY 1),
c AS (SELECT (SELECT count(*) FROM t) AS te, (SELECT count(*) FROM t WHERE hit = 1) AS fo,
  (SELECT count(*) FROM q) AS pe, (SELECT count(*) FROM q WHERE hit = 1) AS ri),
v AS (SELECT *, fo * 1.0 / te AS rec, ri * 1.0 / pe AS pre FROM c)
SELECT te AS true_events, pe AS pred_events, round(rec, 6) AS event_recall, round(pre, 6) AS event_precision,
  round(2 * rec * pre / (rec + pre), 6) AS event_f1 FROM v""")
def event_f1(spark, sf):
    df, n = scored_events(spark, sf)
    return rounded(evaluate.event_f1(df, n, T))


def _long_sql(*names: str) -> str:
    """(metric, value) rows of one-row queries."""
    parts = [
        f"SELECT name AS metric, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({SQL[n]})) ON COLUMNS(*) INTO NAME name VALUE value)"
        for n in names
    ]
    return " UNION ALL ".join(parts)


REPORT = ("basic_statistics", "score_distribution", "prediction_consistency", "synthetic_metrics", "temporal_metrics")


@query("evaluation_report", f"SELECT metric, round(value, 4) AS value FROM ({_long_sql(*REPORT)})")
def evaluation_report(spark, sf):
    """Every metric of unlabelled, timed scores."""
    df, n = scored_events(spark, sf)
    out = evaluate.evaluate(df.select("row_id", "ts", "score"), n, T, labelled=False, timed=True)
    return out.select("metric", r("value", 4).alias("value"))


@query("evaluate_lineitem", f"""
WITH {LINES_SQL}, ev AS (SELECT row_id, (l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()) AS score,
  CAST(l_quantity > 25 AS INTEGER) AS label FROM li),
m AS (SELECT avg(score) AS mu, stddev_pop(score) AS sd FROM ev),
lab AS (SELECT score, label, 'given' AS kind FROM ev UNION ALL SELECT score, CAST(abs((score - mu) / sd) > 2 AS INTEGER), 'made' FROM ev, m),
s AS (SELECT kind, score, sum(label) AS p, count(*) - sum(label) AS n FROM lab GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY kind ORDER BY score) - n AS below, sum(p) OVER (PARTITION BY kind) AS tp, sum(n) OVER (PARTITION BY kind) AS tn FROM s)
SELECT kind, CASE WHEN max(tp) > 0 AND max(tn) > 0 THEN round(sum(p * (below + n / 2.0)) / (max(tp)::DOUBLE * max(tn)), 6) ELSE 0 END AS auc_roc FROM c GROUP BY 1""")
def evaluate_lineitem(spark, sf):
    """Areas under the ROC curve of prices, for given labels and for those of the two-sigma rule."""
    f = lines(spark, sf)
    scored = materialise(minmax(f.df, "l_extendedprice").join(f.df.select("row_id", (F.col("l_quantity") > 25).cast("int").alias("label")), "row_id"), "lines")
    given = evaluate.curve_metrics(scored).select(F.lit("given").alias("kind"), r("auc_roc").alias("auc_roc"))
    made = evaluate.synthetic(scored.drop("label")).select(F.lit("made").alias("kind"), r("synthetic_auc").alias("auc_roc"))
    return given.unionByName(made)
