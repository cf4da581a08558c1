"""Order, runs and univariate series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    HOURLY_SQL, LINES_SQL, SCORED_SQL, THRESHOLD, hourly, lines, query, r, scored_events,
)
from tidemark.functions.scalars import flag
from tidemark.operators import runs, sequences, series, spectrum
from tidemark.operators.order import over_blocks, prefix_sums, running_totals
from tidemark.session import materialise


@query("block_windows", f"""WITH {LINES_SQL}
SELECT row_id, sum(l_quantity) OVER (ORDER BY row_id ROWS BETWEEN 6 PRECEDING AND 4 FOLLOWING) AS s,
  max(l_discount) OVER (ORDER BY row_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM li""")
def block_windows(spark, sf):
    f = lines(spark, sf)
    out = over_blocks(f.df, f.n, {
        "s": lambda w: F.sum("l_quantity").over(w.rowsBetween(-6, 4)),
        "m": lambda w: F.max("l_discount").over(w.rowsBetween(-2, 2)),
    }, before=6, after=4, size=1000)
    return out.select("row_id", "s", "m")


@query("running_totals", f"""WITH {LINES_SQL} SELECT row_id, sum(l_quantity) OVER (ORDER BY row_id) AS total FROM li""")
def sorted_running_totals(spark, sf):
    return prefix_sums(lines(spark, sf).df, ["row_id"], {"total": "l_quantity"}).select("row_id", "total")


@query("running_totals_by_position", f"""WITH {LINES_SQL}
SELECT row_id, sum(l_quantity) OVER (ORDER BY row_id) AS total FROM li""")
def running_totals_by_position(spark, sf):
    f = lines(spark, sf)
    return running_totals(f.df, f.n, {"total": "l_quantity"}).select("row_id", "total")


@query("differences", f"""WITH {SCORED_SQL} SELECT row_id, round(value - lag(value) OVER (ORDER BY row_id), 6) AS step FROM ev""")
def differences(spark, sf):
    df, n = scored_events(spark, sf)
    held = runs.with_previous(df.select("row_id", "value"), n, {"before": "value"})
    return held.select("row_id", r(F.col("value") - F.col("before")).alias("step"))


@query("centred_moving_average", f"""
WITH {HOURLY_SQL}, p AS (SELECT *, CAST(greatest(2, n // 20) AS BIGINT) AS w FROM hr),
m AS (SELECT p.row_id, p.w, p.n, avg(q.y) AS a FROM p JOIN p q
        ON q.row_id BETWEEN p.row_id - p.w // 2 AND p.row_id + (p.w - 1) // 2 GROUP BY 1, 2, 3 HAVING count(*) = p.w)
SELECT p.row_id, round(coalesce(m.a, CASE WHEN p.row_id < p.w // 2 THEN (SELECT a FROM m ORDER BY row_id LIMIT 1)
  ELSE (SELECT a FROM m ORDER BY row_id DESC LIMIT 1) END), 5) AS moving_avg FROM p LEFT JOIN m USING (row_id)""")
def centred_moving_average(spark, sf):
    f = hourly(spark, sf)
    out = series.centred_average(f.df, f.n, max(2, f.n // 20))
    return out.select("row_id", r("moving_avg", 5).alias("moving_avg"))


@query("long_moving_average", f"""
WITH {LINES_SQL}, m AS (SELECT row_id, count(*) OVER () AS n,
  avg(l_quantity) OVER (ORDER BY row_id ROWS BETWEEN 500 PRECEDING AND 499 FOLLOWING) AS a FROM li)
SELECT row_id, round(a, 6) AS moving_avg FROM m WHERE row_id >= 500 AND row_id < n - 499""")
def long_moving_average(spark, sf):
    """A frame beyond the row-by-row limit, taken from running totals."""
    f = lines(spark, sf)
    out = series.moving_sum(f.df.select("row_id", F.col("l_quantity").alias("y")), f.n, 500, 499)
    whole = (F.col("row_id") >= 500) & (F.col("row_id") < f.n - 499)
    return out.where(whole).select("row_id", r(F.col("_sum") / 1000).alias("moving_avg"))


@query("sliding_sequences", f"""
WITH {SCORED_SQL}, s AS (SELECT row_id, count(*) OVER w AS c, sum(value) OVER w AS total,
    first_value(value) OVER w AS head, last_value(value) OVER w AS tail
  FROM ev WINDOW w AS (ORDER BY row_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT row_id, round(total, 4) AS total, head, tail, CAST(c AS INTEGER) AS length FROM s WHERE c = 10""")
def sliding_sequences(spark, sf):
    df, n = scored_events(spark, sf)
    out = sequences.sliding_windows(df, n, 10, F.col("value"))
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return out.select("row_id", r(total, 4).alias("total"), F.col("window")[0].alias("head"),
                      F.element_at("window", -1).alias("tail"), F.size("window").alias("length"))


@query("padded_sequence_scores", f"""
WITH {SCORED_SQL}, s AS (SELECT row_id, avg(value) OVER (ORDER BY row_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM ev)
SELECT row_id, round(CASE WHEN row_id < 9 THEN (SELECT m FROM s WHERE row_id = 9) ELSE m END, 6) AS raw FROM s""")
def padded_sequence_scores(spark, sf):
    df, n = scored_events(spark, sf)
    windows = sequences.sliding_windows(df, n, 10, F.col("value"))
    scored = windows.select("row_id", (F.aggregate("window", F.lit(0.0), lambda a, x: a + x) / 10).alias("raw"))
    return sequences.pad_scores(df, n, materialise(scored, "means"), 10).select("row_id", r("raw").alias("raw"))


RUNS_SQL = f"""{SCORED_SQL}, p AS (SELECT row_id, ts, label, score, CAST(score > {THRESHOLD} AS INTEGER) AS pred FROM ev),
b AS (SELECT *, CASE WHEN pred = 1 AND coalesce(lag(pred) OVER (ORDER BY row_id), 0) = 0 THEN 1 ELSE 0 END AS st,
  CASE WHEN label = 1 AND coalesce(lag(label) OVER (ORDER BY row_id), 0) = 0 THEN 1 ELSE 0 END AS lst FROM p),
rn AS (SELECT *, sum(st) OVER (ORDER BY row_id) AS run, sum(lst) OVER (ORDER BY row_id) AS lrun FROM b)"""


@query("runs", f"""WITH {RUNS_SQL} SELECT CAST(run AS BIGINT) AS run_id, min(row_id) AS first_row, count(*) AS length
FROM rn WHERE pred = 1 GROUP BY run""")
def run_detection(spark, sf):
    df, n = scored_events(spark, sf)
    flagged = df.select("row_id", flag(F.col("score"), THRESHOLD).alias("pred"))
    out = runs.run_ids(flagged, n, {"run_id": "pred"}).where(F.col("run_id").isNotNull())
    return out.groupBy("run_id").agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("length"))


EPISODES_SQL = f"""{RUNS_SQL}, ep AS (
  SELECT run, min(ts) FILTER (pred = 1) AS a, coalesce(min(ts) FILTER (pred = 0), (SELECT max(ts) FROM p)) AS z
  FROM rn WHERE run > 0 GROUP BY run)"""


@query("episodes", f"""WITH {EPISODES_SQL}
SELECT CAST(run AS BIGINT) AS run_id, round((epoch_us(z) - epoch_us(a)) / 1e6, 6) AS seconds FROM ep""")
def episode_durations(spark, sf):
    df, n = scored_events(spark, sf)
    flagged = df.select("row_id", "ts", flag(F.col("score"), THRESHOLD).alias("pred"))
    return runs.episodes(flagged, n).select("run_id", r("seconds").alias("seconds"))


@query("autocorrelation", f"""
WITH {HOURLY_SQL} SELECT b.row_id - a.row_id AS lag, round(sum(a.y * b.y), 4) AS value
FROM hr a JOIN hr b ON b.row_id - a.row_id BETWEEN 0 AND 200 GROUP BY 1""")
def autocorrelation(spark, sf):
    f = hourly(spark, sf)
    return series.autocorrelation(f.df, f.n, 0, 200).select("lag", r("value", 4).alias("value"))


@query("autocorrelation_all_lags", f"""
WITH {HOURLY_SQL} SELECT b.row_id - a.row_id AS lag, round(sum(a.y * b.y), 4) AS value
FROM hr a JOIN hr b ON b.row_id >= a.row_id GROUP BY 1""")
def autocorrelation_all_lags(spark, sf):
    f = hourly(spark, sf)
    return spectrum.all_lags(f.df, f.n).select("lag", r("value", 4).alias("value"))


@query("period_detection", f"""
WITH {HOURLY_SQL}, a AS (SELECT b.row_id - a.row_id AS k, sum(a.y * b.y) AS v FROM hr a JOIN hr b ON b.row_id >= a.row_id GROUP BY 1),
f AS (SELECT k, v, lag(v) OVER (ORDER BY k) AS u, lead(v) OVER (ORDER BY k) AS d, max(v) OVER () AS top FROM a)
SELECT CAST(coalesce(min(k), (SELECT greatest(2, max(n) // 10) FROM hr)) AS BIGINT) AS period
FROM f WHERE k >= 2 AND v > u AND v > d AND v >= 0.1 * top""")
def period_detection(spark, sf):
    f = hourly(spark, sf)
    return f.df.limit(1).select(F.lit(series.detect_period(f.df, f.n)).cast("bigint").alias("period"))


def seasonal_sql(period: int, additive: bool = True) -> str:
    """Decomposition with an even period, residual filled by its median."""
    h = period // 2
    less, mean = ("-", "-") if additive else ("/", "/")
    return f"""tr AS (SELECT row_id, y, n, CASE WHEN row_id >= {h} AND row_id < n - {h} THEN
    (sum(y) OVER (ORDER BY row_id ROWS BETWEEN {h} PRECEDING AND {h - 1} FOLLOWING)
   + sum(y) OVER (ORDER BY row_id ROWS BETWEEN {h - 1} PRECEDING AND {h} FOLLOWING)) / {2.0 * period} END AS trend FROM hr),
ph AS (SELECT row_id % {period} AS phase, avg(y {less} trend) AS s FROM tr GROUP BY 1),
se AS (SELECT phase, s {mean} (SELECT avg(s) FROM ph) AS seasonal FROM ph),
de AS (SELECT row_id, trend, seasonal, y {less} trend {less} seasonal AS resid FROM tr JOIN se ON phase = row_id % {period}),
re AS (SELECT row_id, abs(coalesce(abs(resid), (SELECT median(abs(resid)) FROM de))) AS raw FROM de)"""


def clip_sql(source: str, low: float = 0.05, high: float = 0.95) -> str:
    return f"""qc AS (SELECT quantile_cont(raw, {low}) AS lo, quantile_cont(raw, {high}) AS hi FROM {source}),
cl AS (SELECT row_id, CASE WHEN hi = lo THEN 0 ELSE least(greatest((raw - lo) / (hi - lo), 0), 1) END AS score FROM {source}, qc)"""


@query("seasonal_decomposition", f"""WITH {HOURLY_SQL}, {seasonal_sql(24)}
SELECT row_id, round(trend, 7) AS trend, round(seasonal, 5) AS seasonal, round(resid, 5) AS resid FROM de""")
def seasonal_decomposition(spark, sf):
    f = hourly(spark, sf)
    out = series.decompose(f.df, f.n, 24)
    return out.select("row_id", r("trend", 7).alias("trend"), *[r(c, 5).alias(c) for c in ("seasonal", "resid")])


@query("seasonal_decomposition_multiplicative", f"""WITH {HOURLY_SQL}, {seasonal_sql(24, False)}
SELECT row_id, round(trend, 7) AS trend, round(seasonal, 5) AS seasonal, round(resid, 5) AS resid FROM de""")
def seasonal_decomposition_multiplicative(spark, sf):
    f = hourly(spark, sf)
    out = series.decompose(f.df, f.n, 24, "multiplicative")
    return out.select("row_id", r("trend", 7).alias("trend"), *[r(c, 5).alias(c) for c in ("seasonal", "resid")])
