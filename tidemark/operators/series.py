"""Univariate series operators: moving averages, autocorrelation, decomposition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import over_blocks, pack_blocks, running_totals
from tidemark.operators.quantile import median
from tidemark.operators.spectrum import EXACT_BELOW, block_length, first_peak_of, lag_blocks
from tidemark.session import materialise

FIRST_LAGS = 512  # lags that the search for a period tries before it computes all
LONG_FRAME = 256


def moving_sum(df: DataFrame, n: int, before: int, after: int, y: str = "y", out: str = "_sum") -> DataFrame:
    """Sum over rows [i - before, i + after]; only rows with a full window are meaningful.

    Short frames are summed row by row; long ones as a difference of running
    totals (of the centred values, to keep digits), which costs the same for any length.
    """
    if before + after < LONG_FRAME:
        frame = {out: lambda w: F.sum(y).over(w.rowsBetween(-before, after))}
        return over_blocks(df, n, frame, before, after)
    mean = df.agg(F.avg(y)).first()[0] or 0.0
    totals = materialise(
        running_totals(df.select("row_id", (F.col(y) - F.lit(mean)).alias("_c")), n, {"_upto": "_c"}).select(
            "row_id", "_upto"
        ),
        "totals",
    )
    ahead = totals.select((F.col("row_id") - after).alias("row_id"), F.col("_upto").alias("_high"))
    behind = totals.select((F.col("row_id") + before + 1).alias("row_id"), F.col("_upto").alias("_low"))
    return (
        df.join(ahead, "row_id", "left")
        .join(behind, "row_id", "left")
        .withColumn(out, F.col("_high") - F.coalesce("_low", F.lit(0.0)) + F.lit(mean * (before + after + 1)))
        .drop("_high", "_low")
    )


def centred_average(df: DataFrame, n: int, window: int, y: str = "y") -> DataFrame:
    """Centred moving average over full windows, ends filled with the nearest value.

    An even window reaches one row further back than forward.
    """
    before, after = window // 2, (window - 1) // 2
    whole = (F.col("row_id") >= before) & (F.col("row_id") < n - after)
    out = materialise(
        moving_sum(df, n, before, after, y)
        .withColumn("moving_avg", F.when(whole, F.col("_sum") / F.lit(float(window))))
        .drop("_sum"),
        "moving-average",
    )
    # full windows form one contiguous stretch, so only its two end values are needed
    edge = out.agg(
        F.max(F.when(F.col("row_id") == before, F.col("moving_avg"))).alias("first"),
        F.max(F.when(F.col("row_id") == n - after - 1, F.col("moving_avg"))).alias("last"),
    ).first()
    fill = F.when(F.col("row_id") < before, F.lit(edge["first"])).otherwise(F.lit(edge["last"]))
    return out.withColumn("moving_avg", F.coalesce("moving_avg", fill.cast("double")))


def moving_average_residual(df: DataFrame, n: int, y: str = "y") -> DataFrame:
    """|y - moving average| with a window of a twentieth of the series."""
    out = centred_average(df, n, max(2, n // 20), y)
    return out.withColumn("raw", F.abs(F.col(y) - F.col("moving_avg"))).drop("moving_avg")


def autocorrelation(df: DataFrame, n: int, low: int, high: int, y: str = "y") -> DataFrame:
    """Uncentred sums of y_i * y_(i+k) for low <= k <= high: lag, value.

    Each block of rows meets the rows ``low`` to ``high`` further on; tasks return
    partial sums per lag.  Made for short ranges, since a block holds more rows than the range has lags;
    ``spectrum.all_lags`` gives them all.
    """
    high = min(high, n - 1)
    reach = high - low
    size = max(4 * reach, 8192)
    value = F.col(y).cast("double")
    own, size = pack_blocks(df, n, value, before=0, size=size)
    shifted = df.select((F.col("row_id") - low).alias("row_id"), y).where(F.col("row_id") >= 0)
    other, _ = pack_blocks(shifted, n, value, before=0, after=reach, size=size)
    pairs = own.select("_block", "v").join(
        other.select("_block", F.col("at").alias("later_at"), F.col("v").alias("later")), "_block"
    )

    def products(batches):
        total = np.zeros(reach + 1)
        for batch in batches:
            for block, v, at, later in zip(batch["_block"], batch["v"], batch["later_at"], batch["later"]):
                v, later = np.asarray(v), np.asarray(later)
                width = 1 << int(np.ceil(np.log2(len(v) + len(later))))
                spectrum = np.conj(np.fft.rfft(v, width)) * np.fft.rfft(later, width)
                sums = np.fft.irfft(spectrum, width)[: min(reach + 1, len(later))]
                total[: len(sums)] += sums
        yield pd.DataFrame({"lag": np.arange(low, high + 1), "part": total})

    return pairs.mapInPandas(products, "lag bigint, part double").groupBy("lag").agg(F.sum("part").alias("value"))


def detect_period(df: DataFrame, n: int, y: str = "y") -> int:
    """Smallest lag >= 2 that is a local peak of the autocorrelation, at least a tenth of its top.

    The first ``FIRST_LAGS`` lags are tried alone.  Without a peak among them one transform gives all lags, whose
    peaks are found where they are: a handful of jobs for any length.  Without any peak the period is a tenth of
    the series.
    """
    fallback = max(2, n // 10)
    if n < 4:
        return fallback
    y_ = F.col(y).cast("double")
    seen = df.agg(F.sum(y_ * y_).alias("top"), F.coalesce(F.every(y_ == F.rint(y_)), F.lit(False)).alias("whole")).first()
    top = seen["top"] or 0.0
    whole = seen["whole"] and top < EXACT_BELOW
    first = min(FIRST_LAGS, n - 1)
    values = autocorrelation(df, n, 1, first, y).orderBy("lag").toPandas()["value"].to_numpy()
    peak = first_peak(np.rint(values) if whole else values, 0.1 * top)
    if peak is not None:
        return 1 + peak
    if first == n - 1:
        return fallback
    size = block_length(n)
    return first_peak_of(lag_blocks(df, n, y, whole, size), size, 0.1 * top) or fallback


def first_peak(a: np.ndarray, height: float) -> int | None:
    """First strict local maximum of at least ``height``; a plateau counts at its middle."""
    i = 1
    while i < len(a) - 1:
        if a[i] > a[i - 1]:
            end = i
            while end + 1 < len(a) and a[end + 1] == a[i]:
                end += 1
            if end + 1 < len(a) and a[end + 1] < a[i] and a[i] >= height:
                return (i + end) // 2
            i = end
        i += 1
    return None


def decompose(df: DataFrame, n: int, period: int, model: str = "additive", y: str = "y") -> DataFrame:
    """Classical decomposition: adds trend, seasonal and resid (NULL at both ends)."""
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unknown decomposition model {model}")
    if model == "multiplicative" and df.where(F.col(y) <= 0).limit(1).count():
        raise ValueError("multiplicative decomposition needs positive values")
    half = period // 2
    if period % 2:
        out = moving_sum(df, n, half, half, y).withColumn("trend", F.col("_sum") / F.lit(float(period)))
    else:
        # half weights at both ends: the mean of the two windows of length ``period``
        out = moving_sum(df, n, half, half - 1, y, "_left")
        out = moving_sum(out, n, half - 1, half, y, "_sum")
        out = out.withColumn("trend", (F.col("_left") + F.col("_sum")) / F.lit(2.0 * period)).drop("_left")
    out = out.drop("_sum")
    whole = (F.col("row_id") >= half) & (F.col("row_id") < n - half)
    detrended = F.col(y) - F.col("trend") if model == "additive" else F.col(y) / F.col("trend")
    out = materialise(
        out.withColumn("trend", F.when(whole, F.col("trend"))).withColumns(
            {"detrended": detrended, "phase": F.pmod(F.col("row_id"), F.lit(period)).cast("int")}
        ),
        "trend",
    )
    phases = out.groupBy("phase").agg(F.avg("detrended").alias("seasonal"))
    centre = phases.agg(F.avg("seasonal")).first()[0]
    level = F.col("seasonal") - F.lit(centre) if model == "additive" else F.col("seasonal") / F.lit(centre)
    phases = phases.select("phase", level.alias("seasonal"))
    # one row per phase: small next to the series, but left to the planner when the period is long
    if period <= 1_000_000:
        phases = F.broadcast(phases)
    resid = (
        F.col("detrended") - F.col("seasonal")
        if model == "additive"
        else F.col("detrended") / F.col("seasonal")
    )
    return out.join(phases, "phase").withColumn("resid", resid).drop("phase", "detrended")


def seasonal_residual(df: DataFrame, n: int, period: int, model: str = "additive", y: str = "y") -> DataFrame:
    """|resid| of the decomposition as ``raw``; ends take the median."""
    out = materialise(
        decompose(df, n, period, model, y).withColumn("raw", F.abs("resid")).drop("trend", "seasonal", "resid"),
        "residual",
    )
    mid = median(out, "raw")
    return out.withColumn("raw", F.coalesce("raw", F.lit(mid)))


def fill_median(df: DataFrame, raw: str = "raw") -> DataFrame:
    mid = median(df, raw)
    return df.withColumn(raw, F.coalesce(F.col(raw), F.lit(0.0 if mid is None else mid)))
