"""Registered queries and their SQL equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import Frame
from tidemark.operators.normalise import minmax
from tidemark.session import materialise, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.withColumns(
        {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"}
    )


def scratch(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def r(c, digits: int = 6):
    """Round a column (by name or expression) for comparison."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---------------------------------------------------------------- shared inputs

LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_ORDER = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


def lines(spark, sf) -> Frame:
    """lineitem in its total order with four numeric features."""
    return Frame.of(table(spark, sf, "lineitem"), LINE_FEATURES, LINE_ORDER)


def line_values(spark, sf) -> Frame:
    """The same features without an order, for characteristics that do not depend on one."""
    df = table(spark, sf, "lineitem").select(F.monotonically_increasing_id().alias("row_id"), *LINE_FEATURES)
    return Frame(df, LINE_FEATURES, df.count())


LINES_SQL = f"""li AS (
  SELECT row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1 AS row_id,
         l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_partkey FROM lineitem)"""


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn(
        "k", F.regexp_extract("props", "([0-9]+)", 1).try_cast("double")
    )


def event_frame(spark, sf) -> Frame:
    return Frame.of(events(spark, sf), ("value", "k"), ("ts", "event_id"), "ts")


def scored_events(spark, sf) -> tuple[DataFrame, int]:
    """Events in time order: score = min-max of value, label = error events."""
    from tidemark.operators.order import number_rows

    rows = table(spark, sf, "events").select(
        "ts", "event_id", "value", (F.col("event_type") == "error").cast("int").alias("label")
    )
    placed, n = number_rows(rows, ["ts", "event_id"])
    return materialise(minmax(placed, "value"), "scored"), n


SCORED_SQL = """ev AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id, event_id, ts, value, event_type,
         CAST(event_type = 'error' AS INTEGER) AS label,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
         (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS score
  FROM events)"""

THRESHOLD = 0.2


def hourly(spark, sf) -> Frame:
    """Hourly totals of the event values."""
    totals = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.sum("value").alias("y"))
    return Frame.of(totals, ("y",), ("h",), "h")


HOURLY_SQL = """hr AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS row_id, h, y, count(*) OVER () AS n
  FROM (SELECT date_trunc('hour', ts) AS h, sum(value) AS y FROM events GROUP BY 1))"""


def two_models(spark, sf) -> DataFrame:
    """Long score table of two models: min-max of value, and of k."""
    f = event_frame(spark, sf)
    a = minmax(f.df, "value").select("row_id", "ts", F.lit("by_value").alias("model"), "score")
    b = minmax(f.df, "k").select("row_id", "ts", F.lit("by_k").alias("model"), "score")
    return materialise(a.unionByName(b), "two-models")


TWO_SQL = SCORED_SQL + """, sc AS (
  SELECT row_id, ts, 'by_value' AS model, score FROM ev
  UNION ALL
  SELECT row_id, ts, 'by_k', (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()) FROM ev)"""

MODELS = ["by_value", "by_k"]


def parts(spark, sf) -> DataFrame:
    """Part sizes and prices, scaled to [0, 1]."""
    from tidemark.operators.scale import scale

    df = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), "p_size", "p_retailprice")
    return scale(df, ["p_size", "p_retailprice"], "minmax")


PARTS_SQL = """pt AS (
  SELECT p_partkey AS row_id,
         (CAST(p_size AS DOUBLE) - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()) AS a,
         (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS b
  FROM part)"""
