"""Sources, sinks and field operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import MODELS, SCORED_SQL, TWO_SQL, events, query, r, scratch, table, two_models
from tidemark.functions import scalars
from tidemark.operators.encode import encode_category
from tidemark.operators.normalise import quantile_clip_by
from tidemark.operators.features import rolling_features
from tidemark.operators.order import number_rows
from tidemark.operators.scale import scale_by
from tidemark.sources import readers, sinks

MICROS = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
PARTS_OF_TIME = ["event_id", "value", "hour", "day_of_week", "is_weekend"]
TIME_SQL = """SELECT event_id, value, CAST(hour(ts) AS INTEGER) AS hour,
  CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend FROM events"""


@query("source_csv", TIME_SQL)
def source_csv(spark, sf):
    path = scratch(spark, "csv")
    table(spark, sf, "events").select("event_id", "ts", "value").write.options(header=True, **MICROS).csv(path)
    df = readers.read_events(spark, path, fmt="csv", schema="event_id bigint, ts timestamp, value double", **MICROS)
    return df.select(*PARTS_OF_TIME)


@query("source_csv_inferred", "SELECT event_id, user_id, value, event_type FROM events")
def source_csv_inferred(spark, sf):
    path = scratch(spark, "csv")
    table(spark, sf, "events").select("event_id", "user_id", "value", "event_type").write.option("header", True).csv(path)
    df = readers.read_table(spark, path, fmt="csv")
    return df.select(F.col("event_id").cast("bigint"), F.col("user_id").cast("bigint"), "value", "event_type")


@query("source_tsv", TIME_SQL)
def source_tsv(spark, sf):
    path = scratch(spark, "tsv")
    table(spark, sf, "events").select("event_id", "ts", "value").write.options(header=True, sep="\t", **MICROS).csv(path)
    df = readers.read_events(spark, path, fmt="tsv", schema="event_id bigint, ts timestamp, value double", **MICROS)
    return df.select(*PARTS_OF_TIME)


@query("source_json", TIME_SQL)
def source_json(spark, sf):
    path = scratch(spark, "json")
    table(spark, sf, "events").select("event_id", "ts", "value").write.json(path)
    df = readers.read_events(spark, path, fmt="json", schema="event_id bigint, ts timestamp, value double")
    return df.select(*PARTS_OF_TIME)


@query("source_parquet", TIME_SQL)
def source_parquet(spark, sf):
    return readers.read_events(spark, f"{sf}/events.parquet").select(*PARTS_OF_TIME)


NETFLOW_SQL = """
WITH nf AS (
  SELECT event_id,
    CASE WHEN event_id % 7 = 0 THEN '1.2.3' WHEN event_id % 13 = 0 THEN 'a.b.c.d' WHEN event_id % 17 = 0 THEN NULL
         ELSE concat('10.', user_id % 256, '.', user_id // 256, '.', event_id % 256) END AS src_ip,
    CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS bytes, ts FROM events),
s AS (SELECT *, string_split(src_ip, '.') AS o FROM nf)
SELECT event_id,
  CAST(coalesce(CASE WHEN len(o) = 4 THEN try_cast(o[1] AS BIGINT) * 16777216 + try_cast(o[2] AS BIGINT) * 65536
    + try_cast(o[3] AS BIGINT) * 256 + try_cast(o[4] AS BIGINT) END, 0) AS BIGINT) AS src_ip_numeric,
  try_cast(bytes AS DOUBLE) AS bytes, CAST(hour(ts) AS INTEGER) AS hour
FROM s"""


@query("source_netflow", NETFLOW_SQL)
def source_netflow(spark, sf):
    path = scratch(spark, "netflow")
    e = table(spark, sf, "events")
    ip = (
        F.when(F.col("event_id") % 7 == 0, "1.2.3")
        .when(F.col("event_id") % 13 == 0, "a.b.c.d")
        .when(F.col("event_id") % 17 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("10."), F.col("user_id") % 256, F.lit("."), F.floor(F.col("user_id") / 256),
                            F.lit("."), F.col("event_id") % 256))
    )
    e.select(
        "event_id", F.col("ts").alias("timestamp"), ip.alias("src_ip"), F.lit("10.0.0.1").alias("dst_ip"),
        F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("bytes"),
        F.lit(1).alias("packets"),
    ).write.options(header=True, **MICROS).csv(path)
    schema = "event_id bigint, timestamp timestamp, src_ip string, dst_ip string, bytes string, packets bigint"
    df = readers.read_events(spark, path, kind="netflow", fmt="csv", schema=schema, **MICROS)
    return df.select("event_id", "src_ip_numeric", "bytes", "hour")


SYSTEM_SQL = """
SELECT conv_id AS event_id, turn, CAST(dense_rank() OVER (ORDER BY role) - 1 AS INTEGER) AS level_encoded,
  CAST(length(text) AS INTEGER) AS message_length,
  CAST(coalesce(regexp_matches(text, 'error|fail|exception', 'i'), false) AS INTEGER) AS has_error
FROM conversations"""


@query("source_system_log", SYSTEM_SQL)
def source_system_log(spark, sf):
    path = scratch(spark, "system")
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    table(spark, sf, "conversations").select(
        F.col("conv_id").alias("event_id"), "turn",
        F.timestamp_add("SECOND", F.col("conv_id") * 60 + F.col("turn"), start).alias("timestamp"),
        F.col("role").alias("level"), F.col("text").alias("message"),
    ).write.json(path)
    schema = "event_id bigint, turn bigint, timestamp timestamp, level string, message string"
    df = readers.read_events(spark, path, kind="system", fmt="json", schema=schema)
    return df.select("event_id", "turn", "level_encoded", "message_length", "has_error")


AUTH_SQL = """
SELECT event_id, CAST(dense_rank() OVER (ORDER BY concat('u', user_id)) - 1 AS INTEGER) AS user_encoded,
  CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS action_encoded,
  CAST(167772160 + user_id % 200 AS BIGINT) AS src_ip_numeric, CAST(event_id % 2 AS INTEGER) AS success
FROM events"""


@query("source_auth_log", AUTH_SQL)
def source_auth_log(spark, sf):
    path = scratch(spark, "auth")
    table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("timestamp"), F.concat(F.lit("u"), "user_id").alias("user"),
        F.col("event_type").alias("action"), F.concat(F.lit("10.0.0."), F.col("user_id") % 200).alias("src_ip"),
        (F.col("event_id") % 2).alias("success"),
    ).write.options(header=True, **MICROS).csv(path)
    schema = "event_id bigint, timestamp timestamp, user string, action string, src_ip string, success int"
    df = readers.read_events(spark, path, kind="auth", fmt="csv", schema=schema, **MICROS)
    return df.select("event_id", "user_encoded", "action_encoded", "src_ip_numeric", "success")


@query("timestamp_detection", "SELECT 'ts' AS found, 'l_shipdate' AS found_in_lines, count(*) AS n FROM events")
def timestamp_detection(spark, sf):
    e = table(spark, sf, "events")
    found = readers.detect_timestamp(e)
    dates = table(spark, sf, "lineitem").select("l_quantity", F.col("l_shipdate").cast("string"))
    return e.agg(F.lit(found).alias("found"), F.lit(readers.detect_timestamp(dates)).alias("found_in_lines"),
                 F.count(F.lit(1)).alias("n"))


@query("category_codes", """
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE role END AS role FROM conversations),
d AS (SELECT role, row_number() OVER (ORDER BY role) - 1 AS code FROM (SELECT DISTINCT role FROM c WHERE role IS NOT NULL))
SELECT conv_id, turn, CAST(coalesce(code, -1) AS INTEGER) AS role_encoded FROM c LEFT JOIN d USING (role)""")
def category_codes(spark, sf):
    c = table(spark, sf, "conversations").withColumn(
        "role", F.when(F.col("turn") % 5 != 4, F.col("role"))
    )
    return encode_category(c, "role").select("conv_id", "turn", "role_encoded")


@query("high_cardinality_codes", """
SELECT doc_id, CAST(dense_rank() OVER (ORDER BY md5(text)) - 1 AS INTEGER) AS digest_encoded FROM documents""")
def high_cardinality_codes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    return encode_category(d, "digest").select("doc_id", "digest_encoded")


@query("message_fields", """
SELECT doc_id, CAST(length(text) AS INTEGER) AS message_length,
  CAST(coalesce(regexp_matches(text, 'error|fail|exception', 'i'), false) AS INTEGER) AS has_error FROM documents""")
def message_fields(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", scalars.message_length(F.col("text")).alias("message_length"),
        scalars.has_error(F.col("text")).alias("has_error"),
    )


@query("batch_by_file", f"""
WITH {SCORED_SQL}, st AS (
  SELECT event_type, ts, event_id, value,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS row_id,
    avg(value) OVER (PARTITION BY event_type) AS m, stddev_pop(value) OVER (PARTITION BY event_type) AS s,
    avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rm,
    coalesce(lag(value, 2) OVER (PARTITION BY event_type ORDER BY ts, event_id), 0.0) AS l2 FROM ev),
q AS (SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM ev GROUP BY 1)
SELECT event_id, event_type AS series, row_id, round((value - m) / s, 5) AS scaled, round(rm, 5) AS rolling_mean,
  round(l2, 5) AS lag_2, round(least(greatest((value - lo) / (hi - lo), 0), 1), 5) AS score
FROM st JOIN q USING (event_type)""")
def batch_by_file(spark, sf):
    """Each file is its own series: own order, own statistics."""
    path = scratch(spark, "files")
    table(spark, sf, "events").select("event_id", "ts", "value", "event_type").write.partitionBy("event_type").parquet(path)
    files = spark.read.parquet(path).withColumn(
        "series", F.regexp_extract(F.col("_metadata.file_path"), "event_type=([^/]+)/", 1)
    )
    placed, n = number_rows(files.select("event_id", "ts", "value", "series"), ["ts", "event_id"], ["series"])
    rolled = rolling_features(placed, ["value"], n, series=["series"])
    scored = quantile_clip_by(rolled, ["series"], 0.05, 0.95, raw="value")
    scaled = scale_by(scored.withColumn("scaled", F.col("value")), ["scaled"], ["series"])
    return scaled.select(
        "event_id", "series", "row_id", r("scaled", 5).alias("scaled"),
        r("value_rolling_mean", 5).alias("rolling_mean"), r("value_lag_2", 5).alias("lag_2"), r("score", 5).alias("score"),
    )


@query("scores_sink", f"WITH {TWO_SQL} SELECT model, row_id, round(score, 6) AS score FROM sc")
def scores_sink(spark, sf):
    path = scratch(spark, "scores")
    sinks.write_scores(two_models(spark, sf), path)
    back = spark.read.schema("row_id bigint, ts timestamp, score double, model string").json(path)
    return back.select("model", "row_id", r("score").alias("score"))


SUMMARY_SQL = f"""
WITH {TWO_SQL}, j AS (SELECT sc.model, sc.score, ev.label FROM sc JOIN ev USING (row_id)),
c AS (SELECT model, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM j GROUP BY 1, 2),
a AS (SELECT model, sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) AS auc FROM (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM c) GROUP BY model),
t AS (SELECT model, count(*) FILTER (score > 0.5) AS hits, count(*) FILTER (score > 0.5 AND label = 1) AS tp,
  count(*) FILTER (label = 1) AS pos FROM j GROUP BY 1)
SELECT t.model, hits AS anomalies_detected, round(auc, 6) AS auc_roc,
  round(CASE WHEN hits + pos > 0 THEN 2.0 * tp / (hits + pos) ELSE 0 END, 6) AS f1_score,
  round(CASE WHEN hits > 0 THEN tp * 1.0 / hits ELSE 0 END, 6) AS precision,
  round(CASE WHEN pos > 0 THEN tp * 1.0 / pos ELSE 0 END, 6) AS recall
FROM t JOIN a USING (model)"""


@query("summary_sink", SUMMARY_SQL)
def summary_sink(spark, sf):
    from catalog.registry import scored_events
    from tidemark.plans.pipeline import metrics_of

    scores = two_models(spark, sf)
    labels, n = scored_events(spark, sf)
    labelled = scores.join(labels.select("row_id", "label"), "row_id")
    metrics = metrics_of(labelled, MODELS, n, 0.5, True, False)
    path = scratch(spark, "summary")
    sinks.write_summary(sinks.summary_table(scores, metrics), path)
    back = spark.read.csv(path, header=True, schema="model string, anomalies_detected bigint, auc_roc double, "
                          "f1_score double, precision double, recall double")
    return back.select("model", "anomalies_detected", *[r(c).alias(c) for c in sinks.SUMMARY_METRICS])


@query("alert_sink", f"""WITH {TWO_SQL} SELECT 'WARNING' AS level, model, row_id, round(score, 6) AS score,
  'over limit' AS details FROM sc WHERE score > 0.9""")
def alert_sink(spark, sf):
    path = scratch(spark, "alerts")
    sinks.write_alerts(sinks.alerts(two_models(spark, sf), 0.9, "over limit"), path)
    back = spark.read.schema("level string, model string, row_id bigint, score double, details string").json(path)
    return back.select("level", "model", "row_id", r("score").alias("score"), "details")
