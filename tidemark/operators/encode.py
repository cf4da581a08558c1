"""Categorical codes: rank of each value among the sorted distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import number_rows
from tidemark.operators.skew import join_unique

BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20  # dictionaries up to this size are broadcast


def encode_category(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Add ``<col>_encoded``: 0-based rank in byte order, NULL gives -1."""
    out = out or f"{col}_encoded"
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("_value")).distinct()
    dictionary, size = number_rows(values, ["_value"], pos="_code")
    if size <= BROADCAST_ROWS and (dictionary.agg(F.sum(F.octet_length("_value"))).first()[0] or 0) <= BROADCAST_BYTES:
        dictionary = F.broadcast(dictionary)
        joined = df.join(dictionary, df[col] == F.col("_value"), "left").drop("_value")
    else:
        # every value is in the dictionary, so the inner join loses none; NULLs do not go through it
        known = df.where(F.col(col).isNotNull())
        joined = join_unique(known, dictionary.withColumnRenamed("_value", col), col, known.count())
        joined = joined.unionByName(df.where(F.col(col).isNull()).withColumn("_code", F.lit(None).cast(dictionary.schema["_code"].dataType)))
    return joined.withColumn(out, F.coalesce(F.col("_code"), F.lit(-1)).cast("int")).drop("_code")
