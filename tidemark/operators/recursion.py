"""Linear recursions along the row position, exact for any length and any coefficients.

``x_t = A_t x_(t-1) + b_t`` is an affine map of the state before.  Maps compose, so a block of rows is one map:
tasks compose the rows of their blocks (by doubling: each pass composes stretches of twice the length), the maps
of the blocks are composed the same way, in groups of groups, and the state that enters each block then gives
every row.  Nothing warms up and nothing is cut off: the result is that of walking the rows one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import pack_blocks
from tidemark.session import materialise, shuffle_partitions

FAN = 1024  # maps composed in one task


def compose_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps from the state before the first row to that after each row; ``a`` is (rows, q, q), ``b`` (rows, q)."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        b[step:] += np.einsum("tij,tj->ti", a[step:], b[:-step])
        a[step:] = np.einsum("tij,tjk->tik", a[step:], a[:-step])
        step *= 2
    return a, b


def _entering(maps: DataFrame, count: int, q: int) -> DataFrame:
    """(_block, state): the state before each block, 0 before the first; ``maps`` holds _block, a, b, one row for each of ``count``."""
    spark = maps.sparkSession

    def within(pdf: pd.DataFrame, start: np.ndarray) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        a, b = compose_rows(np.stack(pdf["a"].to_numpy()).reshape(-1, q, q), np.stack(pdf["b"].to_numpy()))
        after = np.einsum("tij,j->ti", a, start) + b
        return pd.DataFrame({"_block": pdf["_block"], "state": list(np.vstack([start[None, :], after[:-1]]))})

    if count <= FAN:
        return maps.withColumn("_group", F.lit(0)).groupBy("_group").applyInPandas(lambda pdf: within(pdf, np.zeros(q)), "_block bigint, state array<double>")

    def whole(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        a, b = compose_rows(np.stack(pdf["a"].to_numpy()).reshape(-1, q, q), np.stack(pdf["b"].to_numpy()))
        return pd.DataFrame({"_block": [key[0]], "a": [a[-1].ravel()], "b": [b[-1]]})

    grouped = maps.withColumn("_group", F.floor(F.col("_block") / FAN)).repartition(shuffle_partitions(spark), "_group")
    groups = materialise(grouped.groupBy("_group").applyInPandas(whole, "_block bigint, a array<double>, b array<double>"), "map-groups")
    outer = _entering(groups, -(-count // FAN), q).select(F.col("_block").alias("_group"), "state")
    joined = grouped.join(outer, "_group")
    return joined.groupBy("_group").applyInPandas(lambda pdf: within(pdf, np.asarray(pdf["state"].iloc[0])), "_block bigint, state array<double>")


def _field(rows: pa.StructArray, name: str) -> pa.Array:
    """The values of a field for the rows of a slice."""
    return pa.compute.struct_field(rows, name)


def filtered(df: DataFrame, n: int, base: str, theta: Column, q: int, new: Column, pos: str = "row_id", size: int | None = None) -> DataFrame:
    """(pos, e): e_t = base_t - theta_1 e_(t-1) - ... - theta_q e_(t-q), exactly.

    ``pos`` is dense from 0 to n - 1.  Rows without a base have no e and count as 0 for later rows; where ``new`` is
    true the series starts afresh.  ``theta`` is an array of q numbers per row (a constant, or that of the row's series).
    """
    value = F.struct(F.col(base).cast("double").alias("base"), theta.cast("array<double>").alias("theta"), new.alias("new"))
    blocks, _ = pack_blocks(df, n, value, before=0, pos=pos, size=size)

    def arrays(flat: np.ndarray, width: int) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, width, dtype=np.int32)), pa.array(flat.ravel()))

    def last_only(n: int, value: np.ndarray) -> pa.Array:
        return pa.array([None] * (n - 1) + [value.ravel()], pa.list_(pa.float64()))

    def compose(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block, at, rows = batch.column(0)[k].as_py(), batch.column(1)[k].values, batch.column(2)[k].values
                n = len(rows)
                b0 = _field(rows, "base").to_numpy(zero_copy_only=False).astype(float)
                weights = _field(rows, "theta").flatten().to_numpy(zero_copy_only=False).reshape(n, q)
                known, fresh = np.isfinite(b0), _field(rows, "new").to_numpy(zero_copy_only=False).astype(bool)
                a, b = np.zeros((n, q, q)), np.zeros((n, q))
                a[:, 0, :] = np.where((known & ~fresh)[:, None], -weights, 0.0)
                for j in range(1, q):
                    a[:, j, j - 1] = ~fresh
                b[:, 0] = np.where(known, b0, 0.0)
                a, b = compose_rows(a, b)
                yield pa.RecordBatch.from_arrays(
                    [
                        at, pa.array(np.full(n, block, np.int64)), pa.array(b[:, 0], mask=~known), arrays(np.ascontiguousarray(a[:, 0, :]), q),
                        last_only(n, a[-1]), last_only(n, b[-1]),
                    ],
                    names=[pos, "_block", "c", "w", "a", "b"],
                )

    schema = f"{pos} bigint, _block bigint, c double, w array<double>, a array<double>, b array<double>"
    rows = materialise(blocks.mapInArrow(compose, schema), "row-maps")
    maps = rows.where("a IS NOT NULL").select("_block", "a", "b")
    count = maps.count()
    entering = materialise(_entering(maps, count, q), "states")
    # a state per block; small tables of them go to every task, larger ones meet the rows by block
    small = F.broadcast(entering) if count <= 100_000 else entering
    carried = F.aggregate(F.zip_with("w", "state", lambda w, s: w * s), F.lit(0.0), lambda t, x: t + x)
    return rows.join(small, "_block").select(pos, (F.col("c") + carried).alias("e"))
