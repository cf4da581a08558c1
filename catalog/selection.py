"""Meta-features, model rules and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.features import COV_SQL, TWO_COLUMNS, scaled_pair
from catalog.registry import (
    LINES_SQL, LINE_FEATURES, MODELS, SCORED_SQL, TWO_SQL, event_frame, line_values, lines, query, r, scored_events, table, two_models,
)
from catalog.sources import SUMMARY_SQL
from tidemark.detectors import registry
from tidemark.operators.normalise import minmax
from tidemark.operators.sampling import md5_sample
from tidemark.plans import report, selection
from tidemark.plans.pipeline import metrics_of
from tidemark.sources.sinks import summary_table


def one_row(spark, values: dict):
    return spark.createDataFrame(
        [tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'bigint' if isinstance(v, int) else 'double'}"
                                            for k, v in values.items())
    )


_PAIRS = [(a, b) for i, a in enumerate(LINE_FEATURES) for b in LINE_FEATURES[i + 1:]]
_MEAN = lambda parts: f"({' + '.join(parts)}) / {len(parts)}.0"


@query("meta_shape", "SELECT CAST(count(*) AS DOUBLE) AS n_samples, 4.0::DOUBLE AS n_features, round(4.0 / count(*), 9) AS dimensionality_ratio FROM lineitem")
def meta_shape(spark, sf):
    m = selection.shape_features(line_values(spark, sf))
    return one_row(spark, m | {"dimensionality_ratio": round(m["dimensionality_ratio"], 9)})


@query("meta_correlation", f"SELECT round({_MEAN([f'abs(corr({a}, {b}))' for a, b in _PAIRS])}, 7) AS mean_correlation FROM lineitem")
def meta_correlation(spark, sf):
    return one_row(spark, {"mean_correlation": round(selection.covariance_features(line_values(spark, sf))["mean_correlation"], 7)})


def _moment(c, k):
    return f"(avg(pow(({c} - m_{c}) / s_{c}, {k})))"


@query("meta_moments", f"""
WITH s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in LINE_FEATURES)} FROM lineitem)
SELECT round({_MEAN([f'abs{_moment(c, 3)}' for c in LINE_FEATURES])}, 6) AS skewness,
  round({_MEAN([f'({_moment(c, 4)} - 3)' for c in LINE_FEATURES])}, 6) AS kurtosis FROM lineitem, s""")
def meta_moments(spark, sf):
    return one_row(spark, {k: round(v, 6) for k, v in selection.moment_features(line_values(spark, sf)).items()})


OUTLIER_SQL = f"""q AS (SELECT {', '.join(f'quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}' for c in LINE_FEATURES)} FROM lineitem),
ou AS (SELECT {_MEAN([f'count(*) FILTER ({c} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * (b_{c} - a_{c}))' for c in LINE_FEATURES])} / count(*) AS outlier_fraction
  FROM lineitem, q)"""


@query("meta_outliers", f"WITH {OUTLIER_SQL} SELECT round(outlier_fraction, 8) AS outlier_fraction FROM ou")
def meta_outliers(spark, sf):
    return one_row(spark, {"outlier_fraction": round(selection.outlier_fraction(line_values(spark, sf)), 8)})


@query("meta_intrinsic_dimension", f"""WITH {COV_SQL}
SELECT CAST(CASE WHEN l1 / (l1 + l2) >= 0.95 THEN 0.5 ELSE 1 END AS DOUBLE) AS intrinsic_dimensionality FROM w""")
def meta_intrinsic_dimension(spark, sf):
    m = selection.covariance_features(scaled_pair(spark, sf))
    return one_row(spark, {"intrinsic_dimensionality": m["intrinsic_dimensionality"]})


@query("meta_order", f"""
WITH {LINES_SQL}, d AS (SELECT {', '.join(f'{c}, {c} - lag({c}) OVER (ORDER BY row_id) AS d_{c}' for c in LINE_FEATURES)},
  lag(l_quantity) OVER (ORDER BY row_id) AS prev FROM li),
s AS (SELECT {_MEAN([f'stddev_pop(d_{c})' for c in LINE_FEATURES])} AS noise, {_MEAN([f'var_pop({c})' for c in LINE_FEATURES])} AS power,
  corr(l_quantity, prev) AS r FROM d)
SELECT round(noise, 4) AS noise_level, round(power / (noise * noise), 6) AS signal_to_noise_ratio,
  round(r, 6) AS lag_correlation, CAST(abs(r) > 0.3 AS DOUBLE) AS series_like FROM s""")
def meta_order(spark, sf):
    m = selection.order_features(lines(spark, sf))
    return one_row(spark, {k: round(v, 4 if k == "noise_level" else 6) for k, v in m.items()})


@query("deterministic_sample", """
SELECT event_id, value FROM events ORDER BY md5(concat('42|', event_id)), event_id LIMIT 200""")
def deterministic_sample(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return md5_sample(e, "event_id", 200, e.count())


@query("meta_sampled")
def meta_sampled(spark, sf):
    """Spread of the forest scores over all rows, and the clustering tendency."""
    f = lines(spark, sf)
    return one_row(spark, {"isolation_score": selection.isolation_spread(f), "clustering_tendency": selection.hopkins(f)})


# probes and the random points beside them come from md5, so that SQL can draw the same ones
_DISTANCE = " + ".join(f"pow(b.{c} - a.{c}, 2)" for c in LINE_FEATURES)
HOPKINS_SQL = f"""{LINES_SQL}, pr AS (SELECT row_id, {', '.join(LINE_FEATURES)} FROM li ORDER BY md5(concat('42|', row_id)), row_id LIMIT 200),
en AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in LINE_FEATURES)} FROM pr),
rd AS (SELECT row_id, {', '.join(f"lo_{c} + (hi_{c} - lo_{c}) * CAST(concat('0x', substr(md5(concat('42|{i}|', row_id)), 1, 8)) AS BIGINT) / 4294967296.0 AS {c}" for i, c in enumerate(LINE_FEATURES))} FROM pr, en),
ho AS (SELECT sum(w) AS w, sum(u) AS u FROM (
  SELECT (SELECT sqrt(min({_DISTANCE})) FROM li b WHERE b.row_id <> a.row_id) AS w, 0.0 AS u FROM pr a
  UNION ALL SELECT 0.0, (SELECT sqrt(min({_DISTANCE})) FROM li b) FROM rd a)),
hk AS (SELECT CASE WHEN w + u > 0 THEN u / (w + u) ELSE 0.5 END AS tendency FROM ho)"""


@query("meta_clustering", f"WITH {HOPKINS_SQL} SELECT round(tendency, 6) AS clustering_tendency FROM hk")
def meta_clustering(spark, sf):
    return one_row(spark, {"clustering_tendency": round(selection.hopkins(lines(spark, sf)), 6)})


@query("selection_fmms")
def selection_fmms(spark, sf):
    return selection.fmms_table(event_frame(spark, sf), registry.names())


# the rules read meta-features of lineitem; with this many rows every |r| above 0.3 is significant
META_SQL = f"""{OUTLIER_SQL}, {HOPKINS_SQL}, lg AS (SELECT corr(l_quantity, prev) AS r FROM (SELECT l_quantity, lag(l_quantity) OVER (ORDER BY row_id) AS prev FROM li)),
mt AS (SELECT count(*) AS n, 4.0 / count(*) AS ratio, max(outlier_fraction) AS outliers,
  max(abs(r)) > 0.3 AS series_like, max(tendency) > 0.5 AS clustered FROM lineitem, ou, lg, hk)"""


def line_meta(spark, sf):
    f = lines(spark, sf)
    return {**selection.shape_features(f), **selection.order_features(f),
            "outlier_fraction": selection.outlier_fraction(f), "clustering_tendency": selection.hopkins(f)}


def model_rows(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "position int, model string")


@query("selection_metaod", f"""WITH {META_SQL}, c AS (
  SELECT 1 AS o, unnest(['pca', 'autoencoder']) AS model FROM mt WHERE ratio > 0.1
  UNION ALL SELECT 2, unnest(['isolation_forest', 'local_outlier_factor']) FROM mt WHERE n > 10000
  UNION ALL SELECT 3, unnest(['dbscan', 'one_class_svm']) FROM mt WHERE outliers > 0.15
  UNION ALL SELECT 4, unnest(['lstm_autoencoder', 'prophet']) FROM mt WHERE series_like)
SELECT model FROM c UNION ALL SELECT 'isolation_forest' WHERE NOT EXISTS (SELECT 1 FROM c)""")
def selection_metaod(spark, sf):
    return model_rows(spark, selection.metaod(line_meta(spark, sf), registry.names())).select("model")


@query("selection_orthus", f"""WITH {META_SQL}
SELECT 'isolation_forest' AS model UNION ALL SELECT CASE WHEN clustered THEN 'gaussian_mixture' ELSE 'dbscan' END FROM mt
UNION ALL SELECT CASE WHEN n > 1000 AND series_like THEN 'lstm_autoencoder' ELSE 'autoencoder' END FROM mt
UNION ALL SELECT 'prophet' FROM mt WHERE series_like""")
def selection_orthus(spark, sf):
    return model_rows(spark, selection.orthus(line_meta(spark, sf), registry.names())).select("model")


@query("selection_union", f"""WITH {META_SQL}, b(model, o, s, wanted) AS (
  SELECT 'isolation_forest', 0, 3, TRUE UNION ALL SELECT 'pca', 1, 2 + CAST(ratio > 0.1 AS INTEGER), ratio > 0.1 FROM mt
  UNION ALL SELECT 'one_class_svm', 2, 1, outliers > 0.15 FROM mt
  UNION ALL SELECT 'local_outlier_factor', 3, 2 + CAST(clustered AS INTEGER), n > 10000 FROM mt
  UNION ALL SELECT 'dbscan', 4, 1, NOT clustered OR outliers > 0.15 FROM mt UNION ALL SELECT 'gaussian_mixture', 5, 1, clustered FROM mt
  UNION ALL SELECT 'autoencoder', 6, 1 + CASE WHEN n > 1000 THEN 2 ELSE 0 END, ratio > 0.1 OR n <= 1000 OR NOT series_like FROM mt
  UNION ALL SELECT 'lstm_autoencoder', 7, 1 + CASE WHEN series_like THEN 2 ELSE 0 END, series_like FROM mt
  UNION ALL SELECT 'prophet', 9, 1, series_like FROM mt),
w AS (SELECT * FROM b WHERE wanted),
c AS (SELECT *, count(*) OVER () AS chosen FROM w),
rk AS (SELECT model, row_number() OVER (ORDER BY CASE WHEN chosen > 3 THEN -s ELSE 0 END, o) - 1 AS position FROM c)
SELECT CAST(position AS INTEGER) AS position, model FROM rk WHERE position < 3""")
def selection_union(spark, sf):
    meta = line_meta(spark, sf)
    names = registry.names()
    chosen = set(selection.metaod(meta, names)) | set(selection.orthus(meta, names))
    return model_rows(spark, selection.fit_bounds(chosen, names, meta, max_models=3))


REGISTRY_SQL = """rg(position, model, need, multi, lean) AS (VALUES
  (0, 'isolation_forest', 10, true, true), (1, 'pca', 50, true, true), (2, 'one_class_svm', 20, true, false),
  (3, 'local_outlier_factor', 20, true, true), (4, 'dbscan', 10, true, true), (5, 'gaussian_mixture', 50, true, true),
  (6, 'autoencoder', 100, true, false), (7, 'lstm_autoencoder', 200, true, false), (8, 'transformer', 500, true, false),
  (9, 'prophet', 100, false, true), (10, 'arima', 50, false, true), (11, 'seasonal_decompose', 100, false, true))"""


@query("model_compatibility", f"""WITH {REGISTRY_SQL}, mt AS (SELECT count(*) AS n, 4 AS d FROM lineitem)
SELECT model, CAST(need AS INTEGER) AS min_samples FROM rg, mt WHERE need <= n AND (multi OR d <= 1)""")
def model_compatibility(spark, sf):
    meta = selection.shape_features(line_values(spark, sf))
    return selection.compatible(spark, meta).select("model", "min_samples")


@query("model_recommendation", f"""WITH {REGISTRY_SQL}, mt AS (SELECT count(*) AS n, 4 AS d FROM lineitem),
s AS (SELECT position, model, CASE WHEN n > 10000 AND lean THEN 2 ELSE 0 END + CASE WHEN d > 10 AND multi THEN 2 ELSE 0 END
  + CASE WHEN n > 50000 AND model IN ('isolation_forest', 'local_outlier_factor', 'pca') THEN 1 ELSE 0 END
  + CASE WHEN model IN ('isolation_forest', 'pca', 'one_class_svm') THEN 1 ELSE 0 END AS suitability
  FROM rg, mt WHERE need <= n AND (multi OR d <= 1))
SELECT CAST(position AS INTEGER) AS position, model, CAST(suitability AS INTEGER) AS suitability FROM s
ORDER BY suitability DESC, position LIMIT 5""")
def model_recommendation(spark, sf):
    return selection.recommend(spark, selection.shape_features(line_values(spark, sf)))


# ---------------------------------------------------------------- chart tables


@query("chart_score_series", f"""WITH {TWO_SQL}
SELECT model, row_id, CAST(epoch_us(ev.ts) AS BIGINT) AS micros, round(sc.score, 6) AS score, 0.5::DOUBLE AS threshold,
  CAST(sc.score > 0.5 AS INTEGER) AS is_anomaly FROM sc JOIN ev USING (row_id)""")
def chart_score_series(spark, sf):
    out = report.score_series(two_models(spark, sf), MODELS)
    return out.select("model", "row_id", F.unix_micros("ts").alias("micros"), r("score").alias("score"), "threshold",
                      F.col("is_anomaly").cast("int").alias("is_anomaly"))


@query("chart_feature_series", f"""WITH {SCORED_SQL}, f AS (
  SELECT row_id, 'value' AS feature, value, CAST(score > 0.2 AS INTEGER) AS is_anomaly FROM ev
  UNION ALL SELECT row_id, 'k', k, CAST(score > 0.2 AS INTEGER) FROM ev) SELECT * FROM f""")
def chart_feature_series(spark, sf):
    f = event_frame(spark, sf)
    out = report.feature_series(f.df, f.features, two_models(spark, sf), "by_value", 0.2)
    return out.select("row_id", "feature", "value", F.col("is_anomaly").cast("int").alias("is_anomaly"))


@query("chart_performance", f"""WITH base AS ({SUMMARY_SQL}),
l AS (SELECT model, unnest(['auc_roc', 'f1_score', 'precision', 'recall']) AS metric, unnest([auc_roc, f1_score, precision, recall]) AS value FROM base)
SELECT model, metric, round(value, 6) AS value, CASE WHEN value >= 0.8 THEN 'good' WHEN value >= 0.6 THEN 'fair' ELSE 'poor' END AS band FROM l""")
def chart_performance(spark, sf):
    scores = two_models(spark, sf)
    labels, n = scored_events(spark, sf)
    metrics = metrics_of(scores.join(labels.select("row_id", "label"), "row_id"), MODELS, n, 0.5, True, False)
    out = report.performance_bands(summary_table(scores, metrics))
    return out.select("model", "metric", r("value").alias("value"), "band")


@query("chart_projection", f"""WITH {COV_SQL}, p AS (SELECT row_id, (x - mx) * vx + (y - my) * vy AS px, (x - mx) * -vy + (y - my) * vx AS q FROM z, w)
SELECT row_id, round(px, 5) AS x, round(abs(q), 5) AS abs_y FROM p""")
def chart_projection(spark, sf):
    f = scaled_pair(spark, sf)
    scores = minmax(f.df, "l_extendedprice").withColumn("model", F.lit("price"))
    # a third, constant feature leaves the plane of the other two unchanged
    flat = report.projection(f.df.withColumn("still", F.lit(1.0)), [*TWO_COLUMNS, "still"], scores, "price")
    return flat.select("row_id", (r("x", 5) + 0.0).alias("x"), r(F.abs("y"), 5).alias("abs_y"))


GRID_SQL = f"""{SCORED_SQL}, gr AS (SELECT score, value, k, min(value) OVER () AS v0, max(value) OVER () AS v1, min(k) OVER () AS k0, max(k) OVER () AS k1 FROM ev)"""


@query("chart_score_grid", f"""WITH {GRID_SQL}
SELECT CAST(least(floor((value - v0) / ((v1 - v0) / 50)), 49) AS INTEGER) AS cx, CAST(least(floor((k - k0) / ((k1 - k0) / 50)), 49) AS INTEGER) AS cy,
  round(avg(score), 6) AS mean_score, count(*) AS points FROM gr GROUP BY 1, 2""")
def chart_score_grid(spark, sf):
    f = event_frame(spark, sf)
    flat = report.projection(f.df, f.features, two_models(spark, sf), "by_value")
    return report.score_grid(flat).select("cx", "cy", r("mean_score").alias("mean_score"), "points")


SURFACE_SQL = f"""{GRID_SQL}, pl AS (SELECT (value - v0) / ((v1 - v0) / 49) AS u, (k - k0) / ((k1 - k0) / 49) AS v, score FROM gr
  WHERE value IS NOT NULL AND k IS NOT NULL AND score IS NOT NULL),
rep AS (SELECT avg(u) AS u, avg(v) AS v, avg(score) AS s FROM pl
  GROUP BY least(floor(u * (50.0::DOUBLE / 49)), 49), least(floor(v * (50.0::DOUBLE / 49)), 49)),
nd AS (SELECT a.i AS gx, b.i AS gy FROM (SELECT unnest(range(50)) AS i) a, (SELECT unnest(range(50)) AS i) b),
far AS (SELECT gx, gy, u - gx AS du, v - gy AS dv, s, 1 / greatest((u - gx) * (u - gx) + (v - gy) * (v - gy), 1e-6) ** 2 AS w FROM nd, rep),
mo AS (SELECT gx, gy, sum(w * du) / sum(w) AS mu, sum(w * dv) / sum(w) AS mv, sum(w * s) / sum(w) AS ms,
  sum(w * du * du) / sum(w) AS uu, sum(w * dv * dv) / sum(w) AS vv, sum(w * du * dv) / sum(w) AS uv,
  sum(w * du * s) / sum(w) AS us, sum(w * dv * s) / sum(w) AS vs FROM far GROUP BY 1, 2),
ce AS (SELECT gx, gy, mu, mv, ms, uu - mu * mu AS uu, vv - mv * mv AS vv, uv - mu * mv AS uv, us - mu * ms AS us, vs - mv * ms AS vs FROM mo),
fi AS (SELECT *, uu * vv - uv * uv AS det FROM ce)"""


@query("chart_score_surface", f"""WITH {SURFACE_SQL}
SELECT CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, round(least(greatest(CASE WHEN det <= 1e-9 * (uu + vv) ** 2 THEN ms
  ELSE ms - (us * vv - vs * uv) / det * mu - (vs * uu - us * uv) / det * mv END, 0), 1), 5) AS score FROM fi""")
def chart_score_surface(spark, sf):
    f = event_frame(spark, sf)
    flat = report.projection(f.df, f.features, two_models(spark, sf), "by_value")
    return report.score_surface(flat).select("gx", "gy", r("score", 5).alias("score"))


@query("chart_histogram", f"""WITH {TWO_SQL}, m AS (SELECT *, min(score) OVER (PARTITION BY model) AS lo, max(score) OVER (PARTITION BY model) AS hi FROM sc)
SELECT model, CAST(least(floor((score - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS frequency FROM m GROUP BY 1, 2""")
def chart_histogram(spark, sf):
    return report.score_histogram(two_models(spark, sf), MODELS)


@query("chart_counts", f"""WITH {TWO_SQL}, c AS (SELECT model, CASE WHEN score > 0.5 THEN 'anomaly' ELSE 'normal' END AS kind, count(*) AS rows FROM sc GROUP BY 1, 2)
SELECT model, kind, rows, round(rows * 100.0 / sum(rows) OVER (PARTITION BY model), 6) AS percentage FROM c""")
def chart_counts(spark, sf):
    return report.anomaly_counts(two_models(spark, sf)).select("model", "kind", "rows", r("percentage").alias("percentage"))


@query("chart_scatter", f"""WITH {LINES_SQL}
SELECT row_id, l_quantity, l_extendedprice, l_discount, l_tax,
  round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 6) AS score FROM li""")
def chart_scatter(spark, sf):
    f = lines(spark, sf)
    scores = minmax(f.df, "l_extendedprice").select("row_id", F.lit("price").alias("model"), "score")
    out = report.scatter_points(f.df, f.features, scores, "price")
    return out.select("row_id", *LINE_FEATURES, r("score").alias("score"))
