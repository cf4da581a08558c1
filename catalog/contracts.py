"""Guards, summaries and properties: what a run promises whatever its models draw by chance."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import LINE_FEATURES, SCORED_SQL, event_frame, line_values, query, r, scratch, table
from tidemark.detectors import registry
from tidemark.detectors.base import Detector
from tidemark.operators.scale import METHODS, scale
from tidemark.plans import selection
from tidemark.plans.pipeline import prepare, run_models
from tidemark.session import materialise
from tidemark.sources.readers import read_events
from tidemark.sources.schemas import LOG_FAMILIES


@query("empty_guard", """SELECT 'all' AS part, count(*) AS rows, FALSE AS refused FROM nation
UNION ALL SELECT 'none', 0, TRUE""")
def empty_guard(spark, sf):
    """Reading a table without rows is refused."""
    nation, out = table(spark, sf, "nation"), []
    for part, df in (("all", nation), ("none", nation.where("n_nationkey < 0"))):
        path = scratch(spark, f"guard-{part}")
        df.write.parquet(path)
        try:
            out.append((part, read_events(spark, path, fmt="parquet").count(), False))
        except ValueError:
            out.append((part, 0, True))
    return spark.createDataFrame(out, "part string, rows bigint, refused boolean")


@query("family_check", """SELECT 'auth' AS family, TRUE AS accepted, count(*) AS rows FROM events
UNION ALL SELECT 'netflow', FALSE, 0 UNION ALL SELECT 'system', FALSE, 0""")
def family_check(spark, sf):
    """Which log family the columns of the events, named as an authentication log, satisfy."""
    log = table(spark, sf, "events").select(F.col("ts").alias("timestamp"), F.col("user_id").alias("user"), F.col("event_type").alias("action"))
    out = []
    for name, family in LOG_FAMILIES.items():
        try:
            family.check(log.columns)
            out.append((name, True, log.count()))
        except ValueError:
            out.append((name, False, 0))
    return spark.createDataFrame(out, "family string, accepted boolean, rows bigint")


@query("scaler_choice", """WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d, min(l_quantity) AS lo, max(l_quantity) AS hi,
  quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.5) AS b, quantile_cont(l_quantity, 0.75) AS c FROM lineitem)
SELECT 'standard' AS method, TRUE AS accepted, round(max((l_quantity - m) / d), 6) AS largest FROM lineitem, s
UNION ALL SELECT 'minmax', TRUE, round(max((l_quantity - lo) / (hi - lo)), 6) FROM lineitem, s
UNION ALL SELECT 'robust', TRUE, round(max((l_quantity - b) / (c - a)), 6) FROM lineitem, s
UNION ALL SELECT 'unheard_of', FALSE, NULL""")
def scaler_choice(spark, sf):
    """Each scaler by name; an unknown one is refused."""
    df, out = table(spark, sf, "lineitem").select("l_quantity"), []
    for method in (*METHODS, "unheard_of"):
        try:
            out.append((method, True, round(scale(df, ["l_quantity"], method).agg(F.max("l_quantity")).first()[0], 6)))
        except ValueError:
            out.append((method, False, None))
    return spark.createDataFrame(out, "method string, accepted boolean, largest double")


@query("preprocessing_summary", f"""SELECT unnest(['rows', 'feature_columns', 'scaling_method', 'missing_strategy', 'feature_engineering', 'pca_applied']) AS item,
  unnest([CAST(count(*) AS VARCHAR), '{",".join(LINE_FEATURES)}', 'minmax', 'median', 'False', 'False']) AS value FROM lineitem""")
def preprocessing_summary(spark, sf):
    done = prepare(table(spark, sf, "lineitem").select(*LINE_FEATURES, "l_orderkey", "l_linenumber", "l_partkey"), features=LINE_FEATURES,
                   order_by=["l_orderkey", "l_linenumber", "l_partkey", *LINE_FEATURES],
                   scaling_method="minmax", missing_strategy="median", feature_engineering=False)
    shown = {"rows": done.frame.n, **{k: done.summary[k] for k in ("feature_columns", "scaling_method", "missing_strategy", "feature_engineering", "pca_applied")}}
    return spark.createDataFrame([(k, ",".join(v) if isinstance(v, list) else str(v)) for k, v in shown.items()], "item string, value string")


class MeanOfFeatures(Detector):
    """A detector as a user writes one: the mean of the features."""

    name = "mean_of_features"

    def raw_scores(self, frame):
        total = sum(F.col(c).cast("double") for c in frame.features)
        return frame.df.select("row_id", (total / len(frame.features)).alias("raw"))


class Failing(Detector):
    name = "failing"

    def raw_scores(self, frame):
        raise RuntimeError("no model for these rows")


def with_own_detectors(work):
    """``work()`` while the two detectors above are registered."""
    try:
        for cls in (MeanOfFeatures, Failing):
            registry.register_detector(cls.name, "statistical", registry.Requirements(1), cls)
        return work()
    finally:
        for cls in (MeanOfFeatures, Failing):
            registry.unregister_detector(cls.name)


MEAN_SQL = f"{SCORED_SQL}, m AS (SELECT row_id, (value + k) / 2 AS raw FROM ev)"


@query("custom_detector", f"""WITH {MEAN_SQL}
SELECT row_id, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 6) AS score FROM m""")
def custom_detector(spark, sf):
    frame = event_frame(spark, sf)
    scores = with_own_detectors(lambda: registry.create("mean_of_features").fit_predict(frame))
    return scores.select("row_id", r("score").alias("score"))


@query("run_audit", """SELECT 'mean_of_features' AS model, 'ok' AS status, CAST(NULL AS VARCHAR) AS message, count(*) AS rows, 2 AS features, count(*) AS scored FROM events
UNION ALL SELECT 'failing', 'failed', 'no model for these rows', count(*), 2, 0 FROM events""")
def run_audit(spark, sf):
    """A failing model is recorded, and the other one still runs."""
    scores, audit = with_own_detectors(lambda: run_models(event_frame(spark, sf), ["mean_of_features", "failing"], skip_failed=True))
    scored = scores.groupBy("model").agg(F.count(F.lit(1)).alias("scored"))
    return audit.join(scored, "model", "left").select("model", "status", "message", "rows", "features", F.coalesce("scored", F.lit(0)).alias("scored"))


@query("selection_summary", """SELECT unnest(['enabled', 'methods_used', 'selected', 'min_models', 'max_models', 'n_samples', 'n_features']) AS item,
  unnest(['True', 'metaod,orthus', 'pca', '2', '5', CAST(count(*) AS VARCHAR), '4']) AS value FROM lineitem""")
def selection_summary(spark, sf):
    meta = selection.shape_features(line_values(spark, sf))
    s = selection.selection_summary(["pca"], meta, ("metaod", "orthus"))
    shown = {
        "enabled": s["enabled"], "methods_used": ",".join(s["methods_used"]), "selected": ",".join(s["selected"]), **s["constraints"],
        "n_samples": int(s["meta_features"]["n_samples"]), "n_features": int(s["meta_features"]["n_features"]),
    }
    return spark.createDataFrame([(k, str(v)) for k, v in shown.items()], "item string, value string")


@query("detector_registry", """WITH g(model, category, need) AS (VALUES ('isolation_forest', 'statistical', 10), ('pca', 'statistical', 50),
  ('one_class_svm', 'statistical', 20), ('local_outlier_factor', 'statistical', 20), ('dbscan', 'statistical', 10), ('gaussian_mixture', 'statistical', 50),
  ('autoencoder', 'deep_learning', 100), ('lstm_autoencoder', 'deep_learning', 200), ('transformer', 'deep_learning', 500),
  ('prophet', 'time_series', 100), ('arima', 'time_series', 50), ('seasonal_decompose', 'time_series', 100))
SELECT model, category, need <= n AS enough_rows FROM g, (SELECT count(*) AS n FROM events)""")
def detector_registry(spark, sf):
    n = table(spark, sf, "events").count()
    return registry.registry_table(spark).select("model", "category", (F.col("min_samples") <= n).alias("enough_rows"))


# ---------------------------------------------------------------- detectors that draw by chance

DRAWN = ("isolation_forest", "one_class_svm", "gaussian_mixture", "prophet", "arima")


def _properties_query(name):
    @query(f"properties_{name}", f"""SELECT '{name}' AS model, count(*) AS rows, 0 AS missing, 0 AS outside, 0.0::DOUBLE AS least, 1.0::DOUBLE AS most,
      TRUE AS finds_the_far FROM events""")
    def run(spark, sf):
        """Every row scored, scores span [0, 1], and planted far rows score higher than the rest on average."""
        f = event_frame(spark, sf)
        # one row in 97 is moved far away from the others
        far = F.pmod(F.col("row_id"), F.lit(97)) == 50
        moved = f.df.withColumns({c: F.when(far, F.col(c) + 40 * F.lit(_deviation(f, c))).otherwise(F.col(c)) for c in f.features})
        frame = f.with_df(materialise(moved, "planted"))
        score = F.col("score")
        return (
            registry.create(name).fit_predict(frame)
            .agg(
                F.count(F.lit(1)).alias("rows"), F.count_if(score.isNull()).cast("int").alias("missing"),
                F.count_if((score < 0) | (score > 1)).cast("int").alias("outside"), F.min(score).alias("least"), F.max(score).alias("most"),
                (F.avg(F.when(far, score)) > F.avg(F.when(~far, score))).alias("finds_the_far"),
            )
            .select(F.lit(name).alias("model"), "rows", "missing", "outside", r("least").alias("least"), r("most").alias("most"), "finds_the_far")
        )


def _deviation(frame, c: str) -> float:
    return float(frame.df.agg(F.stddev_pop(c)).first()[0])


for _name in DRAWN:
    _properties_query(_name)
