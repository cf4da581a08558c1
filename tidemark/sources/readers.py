"""Readers for CSV, TSV, JSON and Parquet event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars
from tidemark.operators.encode import encode_category
from tidemark.sources.schemas import LOG_FAMILIES

# fixed values: names tried, in this order, as the timestamp of an event table
TIMESTAMP_NAMES = (
    "timestamp", "time", "datetime", "date_time", "ts",
    "created_at", "event_time", "log_time", "occurrence_time",
)
# fixed values: fields of each log family that are coerced or encoded on read
IP_FIELDS = ("src_ip", "dst_ip")
NETFLOW_NUMBERS = ("bytes", "packets", "duration", "src_port", "dst_port")
SYSTEM_CATEGORIES = ("level", "source", "user", "process")
AUTH_CATEGORIES = ("user", "action")

_EXTENSIONS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "json", ".parquet": "parquet"}


def _format_of(path: str) -> str:
    for ending, name in _EXTENSIONS.items():
        if ending in path.lower().rsplit("/", 1)[-1]:
            return name
    raise ValueError(f"cannot tell the format of {path}; pass fmt=")


def read_table(
    spark: SparkSession, path, fmt: str | None = None, schema: T.StructType | str | None = None, **options
) -> DataFrame:
    """Plain read.  Give a schema in production: inference costs one more scan."""
    first = path if isinstance(path, str) else path[0]
    fmt = fmt or _format_of(first)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt in ("csv", "tsv"):
        defaults = {"header": True, "inferSchema": schema is None}
        if fmt == "tsv":
            defaults |= {"sep": "\t", "comment": "#"}
        return reader.options(**{**defaults, **options}).csv(path)
    if fmt == "json":
        return reader.options(**options).json(path)
    if fmt == "parquet":
        return reader.options(**options).parquet(*([path] if isinstance(path, str) else path))
    raise ValueError(f"unknown format {fmt}")


def detect_timestamp(df: DataFrame, names=TIMESTAMP_NAMES) -> str | None:
    """Known name first, then a timestamp column, then the first string column all of whose values parse."""
    for name in names:
        if name in df.columns:
            return name
    for field in df.schema:
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return field.name
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return None
    counts = [F.count(x).alias(f"{k}{i}") for i, c in enumerate(texts) for k, x in (("n", F.col(c)), ("ok", F.try_to_timestamp(F.col(c))))]
    seen = df.agg(*counts).first()
    return next((c for i, c in enumerate(texts) if seen[f"n{i}"] and seen[f"n{i}"] == seen[f"ok{i}"]), None)


def process_timestamp(df: DataFrame, ts: str) -> DataFrame:
    """Parse the timestamp and add ``hour``, ``day_of_week``, ``is_weekend``.

    The order by ``ts`` is applied by the operators that need it, not by a sort here.
    """
    kind = df.schema[ts].dataType
    parsed = F.try_to_timestamp(F.col(ts)) if isinstance(kind, T.StringType) else F.col(ts).cast("timestamp")
    df = df.withColumn(ts, parsed)
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": scalars.day_of_week(F.col(ts)),
            "is_weekend": scalars.is_weekend(F.col(ts)),
        }
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def netflow_fields(df: DataFrame) -> DataFrame:
    out = {f"{c}_numeric": scalars.ip_to_numeric(F.col(c)) for c in IP_FIELDS if c in df.columns}
    out |= {c: scalars.to_number(F.col(c)) for c in NETFLOW_NUMBERS if c in df.columns}
    return df.withColumns(out)


def system_fields(df: DataFrame) -> DataFrame:
    for c in SYSTEM_CATEGORIES:
        if c in df.columns:
            df = encode_category(df, c)
    if "message" in df.columns:
        df = df.withColumns(
            {
                "message_length": scalars.message_length(F.col("message")),
                "has_error": scalars.has_error(F.col("message")),
            }
        )
    return df


def auth_fields(df: DataFrame) -> DataFrame:
    for c in AUTH_CATEGORIES:
        if c in df.columns:
            df = encode_category(df, c)
    if "src_ip" in df.columns:
        df = df.withColumn("src_ip_numeric", scalars.ip_to_numeric(F.col("src_ip")))
    return df


_FIELDS = {"netflow": netflow_fields, "system": system_fields, "auth": auth_fields}


def read_events(
    spark: SparkSession,
    path,
    kind: str | None = None,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    timestamp: str | None = None,
    series_by_file: bool = False,
    **options,
) -> DataFrame:
    """Read an event table: guard, timestamp parts, and the fields of its log family."""
    fmt = fmt or _format_of(path if isinstance(path, str) else path[0])
    df = read_table(spark, path, fmt, schema, **options)
    if fmt != "parquet":  # Parquet keeps its plain columns, so that filters reach the scan
        df = nan_to_null(df)
    if series_by_file:
        df = df.withColumn("series", F.col("_metadata.file_path"))
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    ts = timestamp or detect_timestamp(df)
    if ts:
        df = process_timestamp(df, ts)
    if kind:
        LOG_FAMILIES[kind].check(df.columns)
        df = _FIELDS[kind](df)
    return df
