"""Models, imputation and metrics per series: one plan here, a GROUP BY or PARTITION BY of the series in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import LINE_ORDER, events, query, r, table
from tidemark.detectors.per_series import raw_scores_by
from tidemark.operators.evaluate import summary_text
from tidemark.operators.evaluate_groups import evaluate_by
from tidemark.operators.impute import impute_by
from tidemark.operators.normalise import minmax_by
from tidemark.operators.order import number_rows
from tidemark.operators.segments import segment
from tidemark.plans.pipeline import detect_series

LINES_BY_SQL = f"""lb AS (SELECT l_returnflag || l_linestatus AS series, l_quantity AS x, l_extendedprice AS y,
  row_number() OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY {', '.join(LINE_ORDER)}) - 1 AS row_id FROM lineitem)"""


def lines_by(spark, sf):
    """Line items by flag and status, each series in its own order."""
    named = table(spark, sf, "lineitem").withColumn("series", F.concat("l_returnflag", "l_linestatus"))
    return number_rows(named, LINE_ORDER, series=["series"])[0]


HOURLY_BY_SQL = """hb AS (SELECT series, y, row_number() OVER (PARTITION BY series ORDER BY h) - 1 AS row_id, count(*) OVER (PARTITION BY series) AS n
  FROM (SELECT event_type AS series, date_trunc('hour', ts) AS h, sum(value) AS y FROM events GROUP BY 1, 2))"""


def hourly_by(spark, sf):
    """Hourly totals of every event type."""
    totals = table(spark, sf, "events").groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("h")).agg(F.sum("value").alias("y"))
    return segment(number_rows(totals, ["h"], series=["series"])[0], ["series"])


def _shown(segments, raw, digits=5):
    return segments.named(raw.select("_g", "row_id", r("raw", digits).alias("raw")))


@query("series_pca", f"""WITH {LINES_BY_SQL}, z AS (SELECT series, row_id,
  (x - min(x) OVER s) / (max(x) OVER s - min(x) OVER s) AS x, (y - min(y) OVER s) / (max(y) OVER s - min(y) OVER s) AS y FROM lb WINDOW s AS (PARTITION BY series)),
c AS (SELECT series, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM z GROUP BY 1),
l AS (SELECT *, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l1 FROM c),
u AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS vx, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS vy FROM l)
SELECT series, row_id, round(pow((y - my) * vx - (x - mx) * vy, 2) / 2, 6) AS raw FROM z JOIN u USING (series)""")
def series_pca(spark, sf):
    segments = segment(lines_by(spark, sf).select("series", "row_id", "l_quantity", "l_extendedprice"), ["series"])
    return _shown(segments, raw_scores_by(segments, ["l_quantity", "l_extendedprice"], "pca", {"n_components": 1}), 6)


@query("series_seasonal", f"""WITH {HOURLY_BY_SQL},
t AS (SELECT *, CASE WHEN row_id >= 12 AND row_id < n - 12 THEN
    (sum(y) OVER (PARTITION BY series ORDER BY row_id ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) + sum(y) OVER (PARTITION BY series ORDER BY row_id ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING)) / 48 END AS trend FROM hb),
p AS (SELECT series, row_id % 24 AS phase, avg(y - trend) AS s FROM t GROUP BY 1, 2),
q AS (SELECT series, avg(s) AS centre FROM p GROUP BY 1),
e AS (SELECT t.series, t.row_id, abs(y - trend - (p.s - q.centre)) AS raw FROM t JOIN p ON p.series = t.series AND p.phase = t.row_id % 24 JOIN q ON q.series = t.series),
m AS (SELECT series, median(raw) AS mid FROM e GROUP BY 1)
SELECT series, row_id, round(coalesce(raw, mid), 4) AS raw FROM e JOIN m USING (series)""")
def series_seasonal(spark, sf):
    segments = hourly_by(spark, sf)
    return _shown(segments, raw_scores_by(segments, ["y"], "seasonal_decompose", {"period": 24}), 4)


@query("series_arima", f"""WITH {HOURLY_BY_SQL}, w AS (SELECT series, row_id, y - lag(y) OVER (PARTITION BY series ORDER BY row_id) AS w FROM hb),
m AS (SELECT series, median(w) AS mid FROM w GROUP BY 1), s AS (SELECT series, mid, 4 * 1.4826 * median(abs(w - mid)) AS sp FROM w JOIN m USING (series) GROUP BY 1, 2),
c AS (SELECT series, row_id, w, CASE WHEN sp > 0 THEN greatest(least(w, mid + sp), mid - sp) ELSE w END AS c FROM w JOIN s USING (series)),
l AS (SELECT *, lag(c) OVER (PARTITION BY series ORDER BY row_id) AS c1, lag(w) OVER (PARTITION BY series ORDER BY row_id) AS w1 FROM c),
f AS (SELECT series, sum(c * c1) / sum(c1 * c1) AS phi FROM l WHERE c IS NOT NULL AND c1 IS NOT NULL GROUP BY 1),
e AS (SELECT series, row_id, abs(w - phi * w1) AS raw FROM l JOIN f USING (series)),
d AS (SELECT series, median(raw) AS mid FROM e GROUP BY 1)
SELECT series, row_id, round(coalesce(raw, mid), 4) AS raw FROM e JOIN d USING (series)""")
def series_arima(spark, sf):
    segments = hourly_by(spark, sf)
    return _shown(segments, raw_scores_by(segments, ["y"], "arima", {"order": (1, 1, 0)}), 4)


@query("series_prophet")
def series_prophet(spark, sf):
    segments = hourly_by(spark, sf)
    return _shown(segments, raw_scores_by(segments, ["y"], "prophet"))


def _impute_query(strategy, fills):
    @query(f"series_impute_{strategy}", f"""WITH {LINES_BY_SQL}, h AS (SELECT series, row_id, CASE WHEN row_id % 7 <> 3 THEN x END AS x FROM lb),
f AS ({fills}) SELECT series, row_id, round(coalesce(x, fill), 6) AS x FROM h JOIN f USING (series)""")
    def run(spark, sf):
        holed = lines_by(spark, sf).select("series", "row_id", F.when(F.col("row_id") % 7 != 3, F.col("l_quantity")).alias("x"))
        return impute_by(holed, ["x"], ["series"], strategy).select("series", "row_id", r("x").alias("x"))


_impute_query("mean", "SELECT series, avg(x) AS fill FROM h GROUP BY 1")
_impute_query("median", "SELECT series, median(x) AS fill FROM h GROUP BY 1")
# the most frequent value, the smallest of those as frequent
_impute_query("most_frequent", """SELECT series, fill FROM (SELECT series, x AS fill, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, x) AS nth
  FROM h WHERE x IS NOT NULL GROUP BY 1, 2) WHERE nth = 1""")


EVENTS_BY_SQL = """sb AS (SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS row_id,
  (value - min(value) OVER s) / (max(value) OVER s - min(value) OVER s) AS score,
  CAST(coalesce(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE), 0) > 80 AS INTEGER) AS label FROM events WINDOW s AS (PARTITION BY event_type))"""


def _events_by(spark, sf):
    rows = events(spark, sf).select(F.col("event_type").alias("series"), "ts", "event_id", "value", (F.coalesce("k", F.lit(0.0)) > 80).cast("int").alias("label"))
    placed = number_rows(rows, ["ts", "event_id"], series=["series"])[0]
    return minmax_by(placed, ["series"], "value")


@query("series_metrics", f"""WITH {EVENTS_BY_SQL},
ct AS (SELECT series, count(*) AS total_samples, count(*) FILTER (score > 0.5) AS anomalies_detected, count(*) FILTER (score > 0.5 AND label = 1) AS true_positives,
  median(score) AS median_anomaly_score, count(*) FILTER (score > 0.5 AND label = 1) * 1.0 / greatest(count(*) FILTER (label = 1), 1) AS recall FROM sb GROUP BY 1),
gs AS (SELECT series, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM sb GROUP BY 1, 2),
au AS (SELECT series, sum(pos * (coalesce(below, 0) + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc_roc FROM (
  SELECT *, sum(neg) OVER (PARTITION BY series ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM gs) GROUP BY 1),
st AS (SELECT series, row_id, label, CASE WHEN label = 1 AND coalesce(lag(label) OVER (PARTITION BY series ORDER BY row_id), 0) = 0 THEN 1 ELSE 0 END AS starts FROM sb),
ev AS (SELECT series, sum(starts) AS true_events FROM st GROUP BY 1),
wd AS (SELECT * FROM ct JOIN au USING (series) JOIN ev USING (series)),
un AS (UNPIVOT (SELECT series, CAST(total_samples AS DOUBLE) AS total_samples, CAST(anomalies_detected AS DOUBLE) AS anomalies_detected, CAST(true_positives AS DOUBLE) AS true_positives,
  CAST(median_anomaly_score AS DOUBLE) AS median_anomaly_score, CAST(recall AS DOUBLE) AS recall, CAST(auc_roc AS DOUBLE) AS auc_roc, CAST(true_events AS DOUBLE) AS true_events FROM wd)
  ON COLUMNS(* EXCLUDE series) INTO NAME metric VALUE value)
SELECT series, metric, round(value, 6) AS value FROM un""")
def series_metrics(spark, sf):
    """Metrics of every event type in one set of jobs; shown are those that the SQL computes as well."""
    shown = ("total_samples", "anomalies_detected", "true_positives", "median_anomaly_score", "recall", "auc_roc", "true_events")
    return evaluate_by(_events_by(spark, sf), ["series"], 0.5, labelled=True).where(F.col("metric").isin(*shown)).select("series", "metric", r("value").alias("value"))


@query("series_detect")
def series_detect(spark, sf):
    """A whole run for every event type: imputation, scaling, three models, scores in [0, 1]."""
    found = detect_series(events(spark, sf), ["event_type"], ["ts", "event_id"], ["value", "k"], ["pca", "seasonal_decompose", "arima"], ts="ts",
                          model_options={"seasonal_decompose": {"period": 24}}, scaling_method="standard")
    return found.scores


@query("summary_text", f"""WITH {EVENTS_BY_SQL}, ct AS (SELECT series, count(*) AS n, count(*) FILTER (score > 0.5) AS hit FROM sb GROUP BY 1)
SELECT series, 'overall' || chr(10) || '  total_samples: ' || n || chr(10) || '  anomalies_detected: ' || hit AS head FROM ct""")
def metrics_as_text(spark, sf):
    """The first lines of the readable summary of each series (counts are written in full)."""
    metrics = evaluate_by(_events_by(spark, sf), ["series"], 0.5, labelled=True)
    per = metrics.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    text = F.udf(lambda m: "\n".join(summary_text(m).split("\n")[:3]), "string")  # a row per series
    return per.select("series", text("m").alias("head"))
