"""Autocorrelation over all lags of a long series by a transform in two levels, and its first peak."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import pack_blocks
from tidemark.session import parallelism, shuffle_partitions

LEAST_BLOCK = 1024
CELLS = 1 << 21  # complex numbers in the group of one task
STEP_CELLS = 1 << 17  # and in one transform inside it
EXACT_BELOW = float(1 << 40)  # products of whole numbers with a smaller top are rounded to whole numbers

PEAK_PARTS = (
    "start long, head double, head_end long, head_step int, peak long, tail double, tail_start long, tail_step int"
)
_NAMES = [part.split()[0] for part in PEAK_PARTS.split(", ")]


def block_length(n: int) -> int:
    """About the square root of the series, so that both levels have the same length."""
    return max(LEAST_BLOCK, 1 << int(np.ceil(np.log2(max(n, 1)) / 2)))


def lag_blocks(df: DataFrame, n: int, y: str = "y", whole: bool = False, size: int | None = None) -> DataFrame:
    """Sums of y_i * y_(i+k) for every lag k from 0 to n - 1, a row per block of lags: block, values.

    With i = b B + r the lag is k = d B + s: a distance d of blocks and a shift s inside them.  A task turns
    its blocks into spectra of 2 B points; the products of all pairs of blocks at all distances d are, for each
    frequency by itself, an autocorrelation along the blocks, so frequencies are dealt to tasks and transformed
    along b; back in blocks, each distance turns its spectrum into lags.  The shift by B that lets distance
    d + 1 reach down to the lags of d is a change of sign of every second frequency.  Two shuffles of 16 bytes
    a row and O(n log n) work replace the n * n products; groups hold about sqrt(n) numbers per frequency.

    ``df`` has dense positions ``row_id``; NULL and NaN count as 0.  ``whole`` says that all values are whole
    numbers, whose sums are then rounded to whole numbers.
    """
    spark = df.sparkSession
    size = size or block_length(n)
    blocks = -(-max(n, 1) // size)
    points = size + 1
    share = -(-points // (2 * parallelism(spark)))
    width = max(1, min(CELLS // blocks, share))
    value = F.coalesce(F.nanvl(F.col(y).cast("double"), F.lit(0.0)), F.lit(0.0))
    packed, _ = pack_blocks(df, n, value, before=0, size=size)

    def spectra(batches):
        for batch in batches:
            for block, v in zip(batch.column("_block").to_pylist(), batch.column("v")):
                cells = np.fft.rfft(v.values.to_numpy(zero_copy_only=False), 2 * size)
                parts = [cells[k: k + width].tobytes() for k in range(0, points, width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()),
                     pa.array(parts, pa.binary())], names=["block", "part", "cells"])

    def along_blocks(table):
        part = table.column("part")[0].as_py()
        order = np.argsort(table.column("block").to_numpy())
        rows = table.column("cells").take(pa.array(order)).to_pylist()
        held = np.frombuffer(b"".join(rows), np.complex128).reshape(len(rows), -1)
        long = 1 << int(np.ceil(np.log2(2 * len(rows))))
        out = np.empty_like(held)
        step = max(1, STEP_CELLS // long)
        for k in range(0, held.shape[1], step):
            power = np.abs(np.fft.fft(held[:, k: k + step], long, axis=0)) ** 2
            far = np.fft.ifft(power, axis=0)[: len(rows) + 1]
            sign = 1.0 - 2.0 * ((part * width + k + np.arange(far.shape[1])) % 2)
            out[:, k: k + step] = far[:-1] + sign * far[1:]
        return pa.table({"block": pa.array(range(len(rows)), pa.int64()), "part": pa.array([part] * len(rows), pa.int64()),
                         "cells": pa.array([row.tobytes() for row in out], pa.binary())})

    def lags(table):
        block = table.column("block")[0].as_py()
        order = np.argsort(table.column("part").to_numpy())
        spectrum = np.frombuffer(b"".join(table.column("cells").take(pa.array(order)).to_pylist()), np.complex128)
        values = np.fft.irfft(spectrum, 2 * size)[: min(size, n - block * size)]
        if whole:
            values = np.rint(values)
        return pa.table({"block": pa.array([block], pa.int64()), "values": pa.array([values], pa.list_(pa.float64()))})

    parts = packed.select("_block", "v").mapInArrow(spectra, "block long, part long, cells binary")
    count = shuffle_partitions(spark)
    turned = parts.repartition(count, "part").groupBy("part").applyInArrow(along_blocks, "block long, part long, cells binary")
    return turned.repartition(count, "block").groupBy("block").applyInArrow(lags, "block long, values array<double>")


def all_lags(df: DataFrame, n: int, y: str = "y", whole: bool = False) -> DataFrame:
    """The same sums as rows: lag, value.  An empty series has none."""
    if n < 1:
        return df.sparkSession.createDataFrame([], "lag long, value double")
    size = block_length(n)
    rows = lag_blocks(df, n, y, whole, size).select("block", F.posexplode("values").alias("at", "value"))
    return rows.select((F.col("block") * size + F.col("at")).alias("lag"), "value")


def first_peak_of(blocks: DataFrame, size: int, height: float) -> int | None:
    """Smallest lag >= 2 that is a strict local maximum of at least ``height``; a plateau counts at its middle.

    Lags of a block that lie between two changes of value are settled inside it.  What is left of a block is its
    first and last stretch of equal values: one row a block, about sqrt(n) in all, which one task reads in order
    as a stream and keeps one stretch of.  The driver receives one number.
    """

    def inside(batches):
        for batch in batches:
            rows = [_ends(b, b * size, np.asarray(v), height) for b, v in zip(batch["block"], batch["values"])]
            yield pd.DataFrame([row for row in rows if row], columns=_NAMES).astype({"peak": "Int64"})

    def across(batches):
        stretch, peak = _Stretch(height), None
        for batch in batches:
            for row in batch.fillna({"peak": 0}).itertuples(index=False):
                peak = peak or stretch.add(row)
        if peak:
            yield pd.DataFrame({"peak": [peak]})

    parts = blocks.mapInPandas(inside, PEAK_PARTS)
    found = parts.repartition(1).sortWithinPartitions("start").mapInPandas(across, "peak long").first()
    return found and found["peak"]


def _ends(block: int, start: int, a: np.ndarray, height: float) -> tuple | None:
    """What the neighbours of a block have to know of it, in the order of ``PEAK_PARTS``."""
    if block == 0:
        start, a = 1, a[1:]  # lag 0 is no neighbour of lag 1
    if not len(a):
        return None
    changed = np.flatnonzero(np.diff(a) != 0) + 1
    if not len(changed):
        return start, a[0], start, 0, None, a[0], start, 0
    steps = np.sign(a[changed] - a[changed - 1]).astype(int)
    tops = np.flatnonzero((steps[:-1] > 0) & (steps[1:] < 0) & (a[changed[:-1]] >= height))
    peak = (2 * start + int(changed[tops[0]]) + int(changed[tops[0] + 1]) - 1) // 2 if len(tops) else None
    return start, a[0], start + int(changed[0]), int(steps[0]), peak, a[-1], start + int(changed[-1]), int(steps[-1])


class _Stretch:
    """The current stretch of equal values: where it starts and how it was entered (1 from below)."""

    def __init__(self, height: float):
        self.height, self.value, self.start, self.entered = height, None, 1, 0

    def _left(self, step: int, at: int) -> int:
        """Middle of the stretch if it is a peak now that the value changes at lag ``at``, else 0."""
        top = self.entered > 0 > step and self.value >= self.height
        return (self.start + at - 1) // 2 if top else 0

    def add(self, row) -> int:
        """The first peak that ends in the next block, 0 if none."""
        peak = 0
        if self.value is None:
            self.value, self.start = row.head, row.start
        elif row.head != self.value:
            step = 1 if row.head > self.value else -1
            peak = self._left(step, row.start)
            self.value, self.start, self.entered = row.head, row.start, step
        if row.head_step:
            peak = peak or self._left(row.head_step, row.head_end) or int(row.peak)
            self.value, self.start, self.entered = row.tail, row.tail_start, row.tail_step
        return peak
