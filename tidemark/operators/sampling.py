"""Deterministic samples of a bounded size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import md5_key


def md5_sample(df: DataFrame, key: str, size: int, n: int, seed: str = "42") -> DataFrame:
    """The ``size`` rows with the smallest md5(seed|key): the same rows on any cluster.

    A prefix test on the digest keeps about twice the wanted rows before the
    ordering, so no task sorts more than a small multiple of the sample.
    """
    digest = md5_key(seed, F.col(key))
    picked = df.withColumn("_digest", digest)
    share = _share(size, n)
    if share < 1.0:
        cut = f"{int(share * 16**8):08x}"
        near = picked.where(F.col("_digest") < F.lit(cut))
        if near.count() >= size:
            picked = near
    return picked.orderBy("_digest", key).limit(size).drop("_digest")


def hashed_share(df: DataFrame, key: Column, size: int, n: int, seed: int) -> DataFrame:
    """About twice ``size`` rows chosen by a hash of ``key`` (all rows of a small table)."""
    share = _share(size, n)
    if share >= 1.0:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def _share(size: int, n: int) -> float:
    if n <= 0:
        return 1.0
    return min(1.0, (2.0 + 10.0 / math.sqrt(max(size, 1))) * size / n)
