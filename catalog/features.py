"""Feature operators, imputers, scalers, components."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from catalog.registry import LINES_SQL, LINE_FEATURES, SCORED_SQL, event_frame, events, lines, query, r, scored_events, table
from tidemark.functions import scalars
from tidemark.frame import Frame
from tidemark.operators import features, impute, linalg, scale
from tidemark.operators.normalise import quantile_clip
from tidemark.operators.order import number_rows
from tidemark.operators.quantile import quantiles
from tidemark.session import materialise


@query("row_position", f"WITH {SCORED_SQL} SELECT event_id, row_id FROM ev")
def row_position(spark, sf):
    return scored_events(spark, sf)[0].select("event_id", "row_id")


@query("feature_selection", "SELECT count(*) AS n, 'l_quantity,l_extendedprice,l_discount,l_tax' AS suffix_rule FROM lineitem")
def feature_selection(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                             F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"))
    names = features.feature_columns(li, None, "suffix")
    return li.agg(F.count(F.lit(1)).alias("n"), F.lit(",".join(names)).alias("suffix_rule"))


@query("calendar_features", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
  CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend, CAST(month(ts) AS INTEGER) AS month,
  round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos,
  round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS day_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS day_cos
FROM events""")
def calendar_features(spark, sf):
    df = features.calendar_features(table(spark, sf, "events"), "ts")
    return df.select("event_id", "hour_of_day", "day_of_week", "is_weekend", "month",
                     *[(r(c) + 0.0).alias(c) for c in ("hour_sin", "hour_cos", "day_sin", "day_cos")])


def _rolling_sql(cols, order):
    out = []
    for c in cols:
        w = f"OVER (ORDER BY {order} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
        out.append(f"round(avg({c}) {w}, 6) AS {c}_rolling_mean")
        out.append(f"round(coalesce(stddev_samp({c}) {w}, 0), 4) AS {c}_rolling_std")
        out += [f"round(coalesce(lag({c}, {k}) OVER (ORDER BY {order}), 0), 4) AS {c}_lag_{k}" for k in (1, 2, 3)]
    return ", ".join(out)


@query("rolling_and_lag", f"WITH {LINES_SQL} SELECT row_id, {_rolling_sql(LINE_FEATURES, 'row_id')} FROM li")
def rolling_and_lag(spark, sf):
    f = lines(spark, sf)
    df = features.rolling_features(f.df, f.features, f.n)
    return df.select("row_id", *[scalars.rounded(F.col(c), 6 if c.endswith("mean") else 4).alias(c) for c in df.columns if "_rolling_" in c or "_lag_" in c])


ROLLED = [f"{c}_{kind}" for c in ("value", "k") for kind in ("rolling_mean", "rolling_std", "lag_1", "lag_2", "lag_3")]
CALENDAR = ["hour_of_day", "day_of_week", "is_weekend", "month", "hour_sin", "hour_cos", "day_sin", "day_cos"]
ENGINEERED = ["value", "k", *ROLLED, *CALENDAR]
FIRST_FIVE = ENGINEERED[:5]


def digits(*names):
    """Products of decimals are compared in full, those with a deviation or a sine to 4 digits."""
    return 4 if any(part in c for c in names for part in ("std", "sin", "cos")) else 7


def _engineered_sql(columns):
    e = f"""
WITH {SCORED_SQL}, e AS (
  SELECT event_id, value, k, {', '.join(
      f"avg({c}) OVER w AS {c}_rolling_mean, coalesce(stddev_samp({c}) OVER w, 0) AS {c}_rolling_std, "
      + ', '.join(f"coalesce(lag({c}, {j}) OVER (ORDER BY row_id), 0) AS {c}_lag_{j}" for j in (1, 2, 3)) for c in ("value", "k"))},
    CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
    CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend, CAST(month(ts) AS INTEGER) AS month,
    sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
    sin(2 * pi() * (isodow(ts) - 1) / 7) AS day_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS day_cos
  FROM ev WINDOW w AS (ORDER BY row_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""
    shown = [f"round({c}, {digits(c)}) + 0.0 AS {c}" for c in ENGINEERED]
    shown += [f"round({a} * {b}, {digits(a, b)}) + 0.0 AS {a}_x_{b}" for a, b in itertools.combinations(columns, 2)]
    return f"{e} SELECT event_id, {', '.join(shown)} FROM e"


def _engineered(spark, sf, columns=None):
    placed, n = number_rows(events(spark, sf).select("ts", "event_id", "value", "k"), ["ts", "event_id"])
    df, names = features.engineer(placed, ("value", "k"), n, "ts", interactions=True, interaction_columns=columns)
    return df.select("event_id", *[(scalars.rounded(F.col(c).cast("double"), digits(c)) + 0.0).alias(c) for c in names])


@query("engineered_features", _engineered_sql(ENGINEERED))
def engineered_features(spark, sf):
    """All engineered columns and the products of all of them."""
    return _engineered(spark, sf)


@query("engineered_features_named", _engineered_sql(FIRST_FIVE))
def engineered_features_named(spark, sf):
    """All engineered columns and the products of the first five."""
    return _engineered(spark, sf, FIRST_FIVE)


@query("univariate_mean", f"""WITH {LINES_SQL}
SELECT row_id, round((l_quantity + l_extendedprice + l_discount + l_tax) / 4, 5) AS y FROM li""")
def univariate_mean(spark, sf):
    f = lines(spark, sf)
    return f.df.select("row_id", F.round(scalars.row_mean(list(f.features)), 5).alias("y"))


@query("threshold_flag", f"WITH {SCORED_SQL} SELECT event_id, CAST(score > 0.2 AS INTEGER) AS pred FROM ev")
def threshold_flag(spark, sf):
    return scored_events(spark, sf)[0].select("event_id", scalars.flag(F.col("score"), 0.2).alias("pred"))


# ---------------------------------------------------------------- imputation

HOLES_SQL = LINES_SQL + """, h AS (
  SELECT row_id, l_quantity, CASE WHEN row_id % 7 <> 3 THEN l_discount END AS l_discount,
    CASE WHEN row_id % 11 <> 5 THEN l_tax END AS l_tax FROM li)"""
HOLED = ["l_quantity", "l_discount", "l_tax"]


def with_holes(spark, sf):
    df = lines(spark, sf).df
    return df.select(
        "row_id", "l_quantity", F.when(F.col("row_id") % 7 != 3, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("row_id") % 11 != 5, F.col("l_tax")).alias("l_tax"),
    )


def _impute_query(name, strategy, discount, tax):
    sql = f"""WITH {HOLES_SQL}, f AS (SELECT {discount} AS a, {tax} AS b)
SELECT row_id, l_quantity, round(coalesce(l_discount, f.a), 6) AS l_discount, round(coalesce(l_tax, f.b), 6) AS l_tax
FROM h, f"""

    @query(name, sql)
    def run(spark, sf):
        df = impute.impute(with_holes(spark, sf), HOLED, strategy)
        return df.select("row_id", "l_quantity", r("l_discount").alias("l_discount"), r("l_tax").alias("l_tax"))


_impute_query("impute_mean", "mean", "(SELECT avg(l_discount) FROM h)", "(SELECT avg(l_tax) FROM h)")
_impute_query("impute_median", "median", "(SELECT median(l_discount) FROM h)", "(SELECT median(l_tax) FROM h)")
_impute_query(
    "impute_most_frequent", "most_frequent",
    "(SELECT l_discount FROM h WHERE l_discount IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "(SELECT l_tax FROM h WHERE l_tax IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
)
_impute_query("impute_constant", "constant", "0.0", "0.0")


@query("impute_drop", f"""WITH {HOLES_SQL} SELECT row_id, l_quantity, l_discount, l_tax FROM h
WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL""")
def impute_drop(spark, sf):
    return impute.impute(with_holes(spark, sf), HOLED, "drop")


@query("impute_knn", """
WITH p AS (SELECT p_partkey AS row_id, p_retailprice AS b,
    CASE WHEN p_partkey % 9 <> 4 THEN CAST(p_size AS DOUBLE) END AS a FROM part),
d AS (SELECT q.row_id, o.a, row_number() OVER (PARTITION BY q.row_id
      ORDER BY sqrt(2.0 / 1.0 * ((q.b - o.b) * (q.b - o.b))), o.row_id) AS rk
  FROM p q JOIN p o ON q.a IS NULL AND o.a IS NOT NULL),
f AS (SELECT row_id, avg(a) AS v FROM d WHERE rk <= 5 GROUP BY 1)
SELECT p.row_id, round(coalesce(p.a, f.v), 6) AS p_size, p.b AS p_retailprice FROM p LEFT JOIN f USING (row_id)""")
def impute_knn(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.when(F.col("p_partkey") % 9 != 4, F.col("p_size").cast("double")).alias("p_size"), "p_retailprice",
    )
    df = impute.impute(p, ["p_size", "p_retailprice"], "knn")
    return df.select("row_id", r("p_size").alias("p_size"), "p_retailprice")


# ---------------------------------------------------------------- scaling


def _scale_query(name, method, expr):
    cols = ", ".join(f"round({expr.replace('#', c)}, 5) AS {c}" for c in LINE_FEATURES)
    stats = ", ".join(
        f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s, min({c}) AS {c}_lo, max({c}) AS {c}_hi, "
        f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.5) AS {c}_b, quantile_cont({c}, 0.75) AS {c}_c"
        for c in LINE_FEATURES
    )

    @query(name, f"WITH {LINES_SQL}, s AS (SELECT {stats} FROM li) SELECT row_id, {cols} FROM li, s")
    def run(spark, sf):
        f = lines(spark, sf)
        df = scale.scale(f.df, f.features, method)
        return df.select("row_id", *[(r(c, 5) + 0.0).alias(c) for c in f.features])


_scale_query("scale_standard", "standard", "(# - #_m) / #_s")
_scale_query("scale_minmax", "minmax", "(# - #_lo) / (#_hi - #_lo)")
_scale_query("scale_robust", "robust", "(# - #_b) / (#_c - #_a)")


@query("exact_quantiles", """
SELECT round(quantile_cont(l_extendedprice, 0.01), 5) AS q01, round(quantile_cont(l_extendedprice, 0.25), 5) AS q25,
  round(quantile_cont(l_extendedprice, 0.5), 5) AS q50, round(quantile_cont(l_extendedprice, 0.95), 5) AS q95,
  round(quantile_cont(l_discount, 0.3), 5) AS d30 FROM lineitem""")
def exact_quantiles(spark, sf):
    """Forced through the narrowing rounds that large tables take."""
    li = table(spark, sf, "lineitem")
    q = quantiles(li, ["l_extendedprice"], [0.01, 0.25, 0.5, 0.95], small=2000)["l_extendedprice"]
    d = quantiles(li, ["l_discount"], [0.3], small=2000)["l_discount"][0]
    values = dict(zip(["q01", "q25", "q50", "q95"], q)) | {"d30": d}
    return spark.createDataFrame([{k: round(v, 5) for k, v in values.items()}], "q01 double, q25 double, q50 double, q95 double, d30 double")


# ---------------------------------------------------------------- principal components

COV_SQL = LINES_SQL + """, z AS (
  SELECT row_id, l_shipdate, (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS x,
    (l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()) AS y
  FROM li),
c AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM z),
l AS (SELECT *, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l1,
  (a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l2 FROM c),
u AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS vx0, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS vy0 FROM l),
v AS (SELECT *, CASE WHEN (CASE WHEN abs(vx0) >= abs(vy0) THEN vx0 ELSE vy0 END) < 0 THEN -1 ELSE 1 END AS s FROM u),
w AS (SELECT mx, my, l1, l2, s * vx0 AS vx, s * vy0 AS vy FROM v)"""
TWO_COLUMNS = ["l_quantity", "l_extendedprice"]


def scaled_pair(spark, sf):
    f = lines(spark, sf)
    return Frame(materialise(scale.scale(f.df, TWO_COLUMNS, "minmax"), "pair"), tuple(TWO_COLUMNS), f.n)


@query("pca_reduction", f"WITH {COV_SQL} SELECT row_id, round((x - mx) * vx + (y - my) * vy, 5) AS pc_1 FROM z, w")
def pca_reduction(spark, sf):
    f = scaled_pair(spark, sf)
    df = linalg.fit_pca(f.df, f.features, 1).transform(f.df)
    return df.select("row_id", (r("PC_1", 5) + 0.0).alias("pc_1"))


@query("pca_explained", f"""WITH {COV_SQL}
SELECT round(l1 / (l1 + l2), 6) AS explained_variance, CAST(1 AS INTEGER) AS components,
  round(abs(vx), 6) AS l_quantity, round(abs(vy), 6) AS l_extendedprice FROM w""")
def pca_explained(spark, sf):
    f = scaled_pair(spark, sf)
    model = linalg.fit_pca(f.df, f.features, 1)
    weight = model.importance()
    return spark.createDataFrame(
        [(round(model.explained, 6), model.k, *[round(weight[c], 6) for c in TWO_COLUMNS])],
        "explained_variance double, components int, l_quantity double, l_extendedprice double",
    )


@query("pca_detector", f"""WITH {COV_SQL},
e AS (SELECT row_id, pow((y - my) * vx - (x - mx) * vy, 2) / 2 AS raw FROM z, w),
q AS (SELECT quantile_cont(raw, 0.01) AS lo, quantile_cont(raw, 0.99) AS hi FROM e)
SELECT row_id, round(least(greatest((raw - lo) / (hi - lo), 0), 1), 4) AS score FROM e, q""")
def pca_detector(spark, sf):
    f = scaled_pair(spark, sf)
    raw = materialise(linalg.fit_pca(f.df, f.features, 1).with_residual(f.df).select("row_id", "raw"), "residual")
    return quantile_clip(raw, 0.01, 0.99).select("row_id", r("score", 4).alias("score"))
