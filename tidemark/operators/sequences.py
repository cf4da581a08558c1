"""Sliding windows of consecutive rows, and scores padded back to rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import over_blocks, pack_blocks


def sliding_windows(df: DataFrame, n: int, length: int, value: Column) -> DataFrame:
    """One row per full window: row_id of its last row and the values as an array."""
    out = over_blocks(
        df.select("row_id", value.alias("_v")),
        n,
        {"window": lambda w: F.collect_list("_v").over(w.rowsBetween(1 - length, 0))},
        before=length - 1,
    )
    return out.where(F.col("row_id") >= length - 1).select("row_id", "window")


def window_blocks(df: DataFrame, n: int, length: int, vector: Column, size: int | None = None) -> tuple[DataFrame, int]:
    """Blocks of rows with a halo, from which ``windows_of`` cuts windows inside a task."""
    return pack_blocks(df, n, vector, before=length - 1, size=size)


def windows_of(batch: pd.DataFrame, length: int, size: int):
    """Per block: positions of the windows' last rows, and the windows (count, length, d)."""
    for block, at, rows in zip(batch["_block"], batch["at"], batch["v"]):
        at = np.asarray(at)
        x = np.stack([np.asarray(r, dtype=float) for r in rows])
        if len(x) < length:
            continue
        cut = np.lib.stride_tricks.sliding_window_view(x, length, axis=0).transpose(0, 2, 1)
        ends = at[length - 1 :]
        own = ends // size == block
        yield ends[own], cut[own]


def pad_scores(df: DataFrame, n: int, scored: DataFrame, length: int, raw: str = "raw") -> DataFrame:
    """Rows before the first full window take its score; without any window all are 0."""
    first = scored.where(F.col("row_id") == length - 1).select(raw).first()
    fill = float(first[0]) if first is not None else 0.0
    head = df.select("row_id").where(F.col("row_id") < length - 1).withColumn(raw, F.lit(fill))
    return scored.select("row_id", raw).unionByName(head)
