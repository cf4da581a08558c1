"""Runs of flagged rows and gaps between them, along the row position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import over_blocks, running_totals


def with_previous(df: DataFrame, n: int, columns: dict[str, str], pos: str = "row_id") -> DataFrame:
    """Add ``{new: column}`` holding the column's value on the row before."""
    return over_blocks(
        df, n, {new: (lambda w, c=c: F.lag(c).over(w)) for new, c in columns.items()}, before=1, pos=pos
    )


def run_ids(df: DataFrame, n: int, flags: dict[str, str]) -> DataFrame:
    """Number the maximal runs of 1 per flag: ``{new: flag column}``, NULL outside runs."""
    held = with_previous(df, n, {f"_prev_{new}": flag for new, flag in flags.items()})
    starts = {
        f"_start_{new}": ((F.col(flag) == 1) & (F.coalesce(F.col(f"_prev_{new}"), F.lit(0)) == 0)).cast("bigint")
        for new, flag in flags.items()
    }
    summed = running_totals(held.withColumns(starts), n, {new: f"_start_{new}" for new in flags})
    return summed.withColumns(
        {new: F.when(F.col(flag) == 1, F.col(new)) for new, flag in flags.items()}
    ).select(*df.columns, *flags)


def episodes(df: DataFrame, n: int, pred: str = "pred", ts: str = "ts") -> DataFrame:
    """One row per run of 1: run_id, start_ts, end_ts, seconds.

    A run ends at the first normal row after it; a run open at the end of the
    table ends at the last timestamp.  Only rows where the flag changes are kept.
    """
    held = with_previous(df.select("row_id", ts, pred), n, {"_prev": pred})
    turned = F.col(pred) != F.coalesce(F.col("_prev"), F.lit(0))
    starts = held.withColumn("_start", (turned & (F.col(pred) == 1)).cast("bigint"))
    last = df.agg(F.max(F.struct("row_id", F.col(ts).alias("t"))).alias("m")).first()["m"]
    last_ts = F.lit(last["t"] if last else None).cast("timestamp")
    return (
        running_totals(starts, n, {"run_id": "_start"})
        .where(turned)
        .groupBy("run_id")
        .agg(
            F.max(F.when(F.col(pred) == 1, F.col(ts))).alias("start_ts"),
            F.coalesce(F.max(F.when(F.col(pred) == 0, F.col(ts))), last_ts).alias("end_ts"),
        )
        .withColumn("seconds", seconds_between(F.col("start_ts"), F.col("end_ts")))
    )


def gaps(df: DataFrame, n: int, pred: str = "pred", ts: str = "ts") -> DataFrame:
    """Seconds between consecutive flagged rows."""
    counted = running_totals(df.withColumn("_hit", F.col(pred).cast("bigint")), n, {"_nth": "_hit"})
    flagged = counted.where(F.col(pred) == 1).select("row_id", ts, (F.col("_nth") - 1).alias("_nth"))
    held = with_previous(flagged, n, {"_prev": ts}, pos="_nth")
    return held.where(F.col("_prev").isNotNull()).select(
        "row_id", seconds_between(F.col("_prev"), F.col(ts)).alias("seconds")
    )


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)
