"""Neighbour joins, detectors, normalisers, ensembles, pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    HOURLY_SQL, PARTS_SQL, SCORED_SQL, TWO_SQL, event_frame, hourly, lines, parts, query, r, table, two_models,
)
from catalog.series import clip_sql, seasonal_sql
from tidemark.detectors import registry
from tidemark.detectors.ensemble import combine
from tidemark.frame import Frame
from tidemark.operators import neighbours, normalise
from tidemark.plans.pipeline import detect, run_models
from tidemark.session import materialise

VECTORS_SQL = "em AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v")
    )


def vector_frame(spark, sf) -> Frame:
    df = vectors(spark, sf)
    cols = [f"e{i}" for i in range(64)]
    return Frame(df.select("row_id", *[F.col("v")[i].alias(c) for i, c in enumerate(cols)]), tuple(cols), df.count())


@query("knn_join", f"""WITH {VECTORS_SQL}, d AS (
  SELECT a.row_id, b.row_id AS nbr_id, list_distance(a.v, b.v) AS dist FROM em a JOIN em b ON a.row_id <> b.row_id),
k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, nbr_id) AS rank FROM d)
SELECT row_id, nbr_id, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def knn_join(spark, sf):
    out = neighbours.knn_join(vectors(spark, sf), F.col("v"), 10)
    return out.select("row_id", "nbr_id", r("dist").alias("dist"), "rank")


@query("knn_join_low_dimension", f"""WITH {PARTS_SQL}, d AS (
  SELECT p.row_id, q.row_id AS nbr_id, sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) AS dist
  FROM pt p JOIN pt q ON p.row_id <> q.row_id),
k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, nbr_id) AS rank FROM d)
SELECT row_id, nbr_id, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""")
def knn_join_low_dimension(spark, sf):
    v = F.array("p_size", "p_retailprice")
    return neighbours.knn_join(parts(spark, sf), v, 5).select("row_id", "nbr_id", r("dist").alias("dist"), "rank")


@query("radius_join", f"""WITH {PARTS_SQL}
SELECT p.row_id, count(*) AS n FROM pt p JOIN pt q
  ON sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) <= 0.0537 GROUP BY 1""")
def radius_join(spark, sf):
    return neighbours.radius_counts(parts(spark, sf), F.array("p_size", "p_retailprice"), 0.0537)


@query("radius_join_high_dimension", f"""WITH {VECTORS_SQL}
SELECT a.row_id, count(*) AS n FROM em a JOIN em b ON list_distance(a.v, b.v) <= 1.3 GROUP BY 1""")
def radius_join_high_dimension(spark, sf):
    return neighbours.radius_counts(vectors(spark, sf), F.col("v"), 1.3)


@query("nearest_core_point", f"""WITH {PARTS_SQL}, d AS (
  SELECT p.row_id, q.row_id AS nbr_id, sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) AS dist
  FROM pt p JOIN pt q ON p.row_id % 5 = 0 AND q.row_id % 5 <> 0)
SELECT row_id, round(min(dist), 6) AS dist FROM d GROUP BY 1""")
def nearest_core_point(spark, sf):
    points = parts(spark, sf).select(F.col("row_id").alias("pid"), F.array("p_size", "p_retailprice").alias("v"))
    cores = points.where(F.col("pid") % 5 != 0).withColumn("ids", F.array("pid"))
    out = neighbours.knn_points(points.where(F.col("pid") % 5 == 0), cores, cores.count(), 1)
    return out.select(F.col("pid").alias("row_id"), r("dist").alias("dist"))


@query("local_outlier_factor", f"""WITH {VECTORS_SQL}, d AS (
  SELECT a.row_id, b.row_id AS o, list_distance(a.v, b.v) AS dist FROM em a JOIN em b ON a.row_id <> b.row_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, o) AS rk FROM d) WHERE rk <= 20),
kd AS (SELECT row_id, max(dist) AS kd FROM k GROUP BY 1),
lr AS (SELECT k.row_id, 1 / (avg(greatest(kd.kd, k.dist)) + 1e-10) AS lrd FROM k JOIN kd ON kd.row_id = k.o GROUP BY 1),
lo AS (SELECT k.row_id, avg(o.lrd) / max(p.lrd) AS lof FROM k JOIN lr o ON o.row_id = k.o JOIN lr p ON p.row_id = k.row_id GROUP BY 1)
SELECT row_id, round(least(greatest((lof - 1) / greatest((SELECT max(lof) FROM lo) - 1, 1e-8), 0), 1), 5) AS score FROM lo""")
def local_outlier_factor(spark, sf):
    scores = registry.create("local_outlier_factor").fit_predict(vector_frame(spark, sf))
    return scores.select("row_id", r("score", 5).alias("score"))


DBSCAN_SQL = f"""{PARTS_SQL}, x AS (SELECT row_id, a, b FROM pt),
near AS (SELECT p.row_id, count(*) AS c FROM x p JOIN x q
  ON sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) <= 0.0237 GROUP BY 1),
core AS (SELECT x.* FROM x JOIN near USING (row_id) WHERE c >= 5),
gap AS (SELECT p.row_id, min(sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b))) AS g
  FROM x p JOIN core q ON p.row_id NOT IN (SELECT row_id FROM core) GROUP BY 1)"""


@query("dbscan", f"""WITH {DBSCAN_SQL}, noise AS (SELECT * FROM gap WHERE g > 0.0237)
SELECT x.row_id, CASE WHEN NOT EXISTS (SELECT 1 FROM core) THEN 1.0::DOUBLE
  ELSE round(coalesce(g / (SELECT max(g) FROM noise), 0), 5) END AS score FROM x LEFT JOIN noise USING (row_id)""")
def dbscan(spark, sf):
    df = parts(spark, sf)
    frame = Frame(df, ("p_size", "p_retailprice"), df.count())
    scores = registry.create("dbscan", eps=0.0237, min_samples=5).fit_predict(frame)
    return scores.select("row_id", r("score", 5).alias("score"))


@query("dbscan_noise", f"""WITH {DBSCAN_SQL} SELECT x.row_id,
  CAST(x.row_id NOT IN (SELECT row_id FROM core) AND coalesce(g > 0.0237, true) AS INTEGER) AS noise
FROM x LEFT JOIN gap USING (row_id)""")
def dbscan_noise(spark, sf):
    """Rows that belong to no cluster; the clusters themselves come from connected components."""
    df = parts(spark, sf)
    frame = Frame(df, ("p_size", "p_retailprice"), df.count())
    found = registry.create("dbscan", eps=0.0237, min_samples=5).labels(frame)
    return found.select("row_id", (F.col("cluster") < 0).cast("int").alias("noise"))


@query("dbscan_labels", f"""WITH RECURSIVE {DBSCAN_SQL},
e AS (SELECT p.row_id AS i, q.row_id AS j FROM core p JOIN core q ON sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) <= 0.0237),
reach(i, j) AS (SELECT row_id, row_id FROM core UNION SELECT e.i, r.j FROM reach r JOIN e ON e.j = r.i WHERE r.j < e.i),
root AS (SELECT i AS row_id, min(j) AS root FROM reach GROUP BY 1),
number AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM root)),
close AS (SELECT p.row_id, q.row_id AS nbr, row_number() OVER (PARTITION BY p.row_id ORDER BY sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)), q.row_id) AS k
  FROM gap g JOIN x p USING (row_id) JOIN core q ON sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) <= 0.0237 WHERE g.g <= 0.0237),
member AS (SELECT row_id, root FROM root UNION ALL SELECT c.row_id, root.root FROM close c JOIN root ON root.row_id = c.nbr WHERE k = 1)
SELECT x.row_id, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster FROM x LEFT JOIN member USING (row_id) LEFT JOIN number USING (root)""")
def dbscan_labels(spark, sf):
    """Cluster numbers in the order of each cluster's first core row."""
    df = parts(spark, sf)
    frame = Frame(df, ("p_size", "p_retailprice"), df.count())
    return registry.create("dbscan", eps=0.0237, min_samples=5).labels(frame).select("row_id", "cluster")


@query("dbscan_cluster_sizes")
def dbscan_cluster_sizes(spark, sf):
    found = registry.create("dbscan", eps=0.1).labels(lines(spark, sf))
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))


@query("seasonal_detector", f"""WITH {HOURLY_SQL}, {seasonal_sql(24)}, {clip_sql('re')}
SELECT row_id, round(score, 5) AS score FROM cl""")
def seasonal_detector(spark, sf):
    scores = registry.create("seasonal_decompose", period=24).fit_predict(hourly(spark, sf))
    return scores.select("row_id", r("score", 5).alias("score"))


@query("moving_average_detector", f"""
WITH {HOURLY_SQL}, p AS (SELECT *, CAST(greatest(2, n // 20) AS BIGINT) AS w FROM hr),
m AS (SELECT p.row_id, p.w, avg(q.y) AS a FROM p JOIN p q
        ON q.row_id BETWEEN p.row_id - p.w // 2 AND p.row_id + (p.w - 1) // 2 GROUP BY 1, 2 HAVING count(*) = p.w),
re AS (SELECT p.row_id, abs(p.y - coalesce(m.a, CASE WHEN p.row_id < p.w // 2 THEN (SELECT a FROM m ORDER BY row_id LIMIT 1)
  ELSE (SELECT a FROM m ORDER BY row_id DESC LIMIT 1) END)) AS raw FROM p LEFT JOIN m USING (row_id)), {clip_sql('re')}
SELECT row_id, round(score, 5) AS score FROM cl""")
def moving_average_detector(spark, sf):
    """A period longer than half the series falls back to the moving average."""
    f = hourly(spark, sf)
    scores = registry.create("seasonal_decompose", period=f.n).fit_predict(f)
    return scores.select("row_id", r("score", 5).alias("score"))


@query("arima_110", f"""
WITH {HOURLY_SQL}, w AS (SELECT row_id, y - lag(y) OVER (ORDER BY row_id) AS w FROM hr),
m AS (SELECT median(w) AS mid FROM w), s AS (SELECT mid, 4 * 1.4826 * median(abs(w - mid)) AS sp FROM w, m GROUP BY mid),
c AS (SELECT row_id, w, greatest(least(w, mid + sp), mid - sp) AS c FROM w, s),
l AS (SELECT row_id, w, c, lag(c) OVER (ORDER BY row_id) AS c1, lag(w) OVER (ORDER BY row_id) AS w1 FROM c),
f AS (SELECT sum(c * c1) / sum(c1 * c1) AS phi FROM l WHERE c IS NOT NULL AND c1 IS NOT NULL),
e AS (SELECT row_id, abs(w - phi * w1) AS raw0 FROM l, f),
re AS (SELECT row_id, coalesce(raw0, (SELECT median(raw0) FROM e)) AS raw FROM e), {clip_sql('re')}
SELECT row_id, round(score, 5) AS score FROM cl""")
def arima_110(spark, sf):
    scores = registry.create("arima", order=(1, 1, 0)).fit_predict(hourly(spark, sf))
    return scores.select("row_id", r("score", 5).alias("score"))


# ---------------------------------------------------------------- normalisers and ensembles


@query("normalise_minmax", f"""WITH {SCORED_SQL}
SELECT row_id, round((max(value) OVER () - value) / (max(value) OVER () - min(value) OVER ()), 6) AS score FROM ev""")
def normalise_minmax(spark, sf):
    f = event_frame(spark, sf)
    return normalise.minmax(f.df, "value", flip=True).select("row_id", r("score").alias("score"))


@query("normalise_quantile", f"""WITH {SCORED_SQL}, q AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM ev)
SELECT row_id, round(least(greatest((value - lo) / (hi - lo), 0), 1), 5) AS score FROM ev, q""")
def normalise_quantile(spark, sf):
    f = event_frame(spark, sf)
    return normalise.quantile_clip(f.df, 0.05, 0.95, "value").select("row_id", r("score", 5).alias("score"))


@query("normalise_above_one", f"""WITH {SCORED_SQL}
SELECT row_id, round(least(greatest((value - 1) / greatest(max(value) OVER () - 1, 1e-8), 0), 1), 5) AS score FROM ev""")
def normalise_above_one(spark, sf):
    f = event_frame(spark, sf)
    return normalise.above_one(f.df, "value").select("row_id", r("score", 5).alias("score"))


@query("contamination_flag", f"""WITH {SCORED_SQL}
SELECT row_id, CAST(value > (SELECT quantile_cont(value, 0.9) FROM ev) AS INTEGER) AS flag FROM ev""")
def contamination_flag(spark, sf):
    f = event_frame(spark, sf)
    return normalise.contamination_flag(f.df, 0.1, "value").select("row_id", "flag")


def _given_arima(name, phi, theta):
    """Residuals at given coefficients against the recursion walked row by row."""
    @query(name, f"""WITH RECURSIVE {HOURLY_SQL}, wd AS (SELECT row_id, y - lag(y) OVER (ORDER BY row_id) AS w FROM hr),
bs AS (SELECT row_id, w - 0.01 - {phi} * lag(w) OVER (ORDER BY row_id) AS base FROM wd),
rc(row_id, e) AS (SELECT CAST(-1 AS BIGINT), CAST(0 AS DOUBLE) UNION ALL
  SELECT bs.row_id, coalesce(bs.base - {theta} * rc.e, 0) FROM rc JOIN bs ON bs.row_id = rc.row_id + 1),
md AS (SELECT median(abs(e)) AS m FROM rc WHERE row_id >= 2)
SELECT row_id, round(CASE WHEN row_id >= 2 THEN abs(e) ELSE m END, 4) AS raw FROM rc, md WHERE row_id >= 0""")
    def run(spark, sf):
        detector = registry.create("arima", order=(1, 1, 1), coefficients=(0.01, [phi], [theta]))
        return detector.raw_scores(hourly(spark, sf)).select("row_id", r("raw", 4).alias("raw"))


_given_arima("arima_given", 0.3, 0.6)
_given_arima("arima_slow_root", -0.2, -0.99)


def _ensemble(method, agg, weights=None):
    @query(f"ensemble_{method}", f"WITH {TWO_SQL} SELECT row_id, round({agg}, 5) AS score FROM sc GROUP BY 1")
    def run(spark, sf):
        out = combine(two_models(spark, sf), method, weights)
        return out.select("row_id", r("score", 5).alias("score"))


_ensemble("average", "avg(score)")
_ensemble("max", "max(score)")
_ensemble("median", "median(score)")
_ensemble("weighted", "sum(score * CASE model WHEN 'by_k' THEN 0.3 ELSE 0.7 END) / sum(CASE model WHEN 'by_k' THEN 0.3 ELSE 0.7 END)",
          {"by_k": 0.3, "by_value": 0.7})


# ---------------------------------------------------------------- pipelines


@query("detect_seasonal", f"""WITH {HOURLY_SQL}, {seasonal_sql(24)}, {clip_sql('re')}
SELECT cl.row_id, CAST(epoch_us(h) // 1000000 AS BIGINT) AS second, 'seasonal_decompose' AS model, round(score, 5) AS score
FROM cl JOIN hr USING (row_id)""")
def detect_seasonal(spark, sf):
    """Hourly totals through the whole pipeline with one exact model."""
    totals = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("value").alias("total"))
    found = detect(totals, order_by=["ts"], features=["total"], models=["seasonal_decompose"],
                   model_options={"seasonal_decompose": {"period": 24}}, feature_engineering=False)
    return found.scores.select("row_id", F.unix_seconds("ts").alias("second"), "model", r("score", 5).alias("score"))


@query("detect_with_labels", f"""WITH {HOURLY_SQL}, {seasonal_sql(24)}, {clip_sql('re')}
SELECT 'seasonal_decompose' AS model, count(*) FILTER (score > 0.5) AS anomalies_detected,
  round(count(*) FILTER (score > 0.5 AND lb = 1) * 1.0 / count(*) FILTER (score > 0.5), 5) AS precision,
  round(count(*) FILTER (score > 0.5 AND lb = 1) * 1.0 / count(*) FILTER (lb = 1), 5) AS recall
FROM cl JOIN (SELECT row_id, CAST(y > 250 AS INTEGER) AS lb FROM hr) USING (row_id)""")
def detect_with_labels(spark, sf):
    totals = (
        table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("value").alias("total"))
        .withColumn("busy", (F.col("total") > 250).cast("int"))
    )
    found = detect(totals, order_by=["ts"], features=["total"], models=["seasonal_decompose"], label_col="busy",
                   model_options={"seasonal_decompose": {"period": 24}}, feature_engineering=False)
    return found.summary.select("model", "anomalies_detected", r("precision", 5).alias("precision"), r("recall", 5).alias("recall"))


def _detector_query(name):
    @query(f"detector_{name}")
    def run(spark, sf):
        return registry.create(name).fit_predict(event_frame(spark, sf))


for _name in ("isolation_forest", "one_class_svm", "gaussian_mixture", "autoencoder", "lstm_autoencoder",
              "transformer", "prophet", "arima"):
    _detector_query(_name)


@query("detect_many_models")
def detect_many_models(spark, sf):
    """Several models on the line items, combined to one ensemble score."""
    scores, _ = run_models(lines(spark, sf), ["isolation_forest", "pca", "gaussian_mixture"])
    return combine(materialise(scores, "scores"), "average")


@query("detect_automatically")
def detect_automatically(spark, sf):
    """Model choice from the data's characteristics, then detection and summary."""
    f = event_frame(spark, sf)
    found = detect(f.df.select("ts", "value", "k", "row_id"), order_by=["row_id"], features=["value", "k"],
                   auto_select=True, skip_failed=False)
    return found.summary
