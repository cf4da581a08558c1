"""Equi-join against a table with unique keys when a few left keys may be huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_PARTS = 1000


def join_unique(left: DataFrame, right: DataFrame, key: str, n_left: int) -> DataFrame:
    """Inner join; keys holding more than 1/1000 of the left rows are served by broadcast.

    There are at most 1000 such keys, so the broadcast has a fixed bound; all
    other keys go through the ordinary shuffle join.
    """
    limit = max(n_left // HOT_PARTS, 10_000)
    if n_left <= limit:
        return left.join(right, key)
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(key)
    hot = counts.toPandas()[key].tolist()
    if not hot:
        return left.join(right, key)
    keys = left.sparkSession.createDataFrame([(h,) for h in hot], left.select(key).schema)
    hot_right = right.join(F.broadcast(keys), key, "left_semi")
    served = left.join(F.broadcast(hot_right), key)
    rest = left.join(F.broadcast(keys), key, "left_anti").join(right, key)
    return served.unionByName(rest)


def join_series(left: DataFrame, right: DataFrame, series: Sequence[str], n_left: int | None = None) -> DataFrame:
    """Inner join on the columns of a series (NULL equals NULL); ``right`` has one row per series.

    A series may hold most of the rows: it is served like any other huge key.
    """
    key = F.xxhash64(*series)
    named = right.withColumnsRenamed({c: f"_right_{c}" for c in series})
    keyed = named.withColumn("_series", F.xxhash64(*[f"_right_{c}" for c in series]))
    joined = join_unique(left.withColumn("_series", key), keyed, "_series", left.count() if n_left is None else n_left)
    for c in series:  # series whose hashes meet are told apart
        joined = joined.where(F.col(c).eqNullSafe(F.col(f"_right_{c}")))
    return joined.drop("_series", *[f"_right_{c}" for c in series])
