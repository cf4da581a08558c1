"""Global order without a single-partition window.

``with_position`` numbers the rows of a totally ordered table, ``prefix_sums``
adds running totals, ``over_blocks`` evaluates row frames on equally sized
blocks that carry a halo of neighbouring rows.  Data moves by one range shuffle
(numbering) or one hash shuffle on the block (frames); only per-partition
counts and sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.skew import join_series
from tidemark.session import materialise, parallelism, shuffle_partitions

MIN_BLOCK = 1024
MAX_BLOCK = 262_144
DRIVER_BLOCKS = 100_000  # block totals the driver adds up itself
_IN_PARTITION = (1 << 33) - 1  # low 33 bits of monotonically_increasing_id


def _sorted_slots(df: DataFrame, keys: Sequence, carried: Sequence[str] | None = None) -> DataFrame:
    """Range-partition and sort by ``keys``; ``_slot`` = sorted partition, ``_in_slot`` = row in it.

    Of the columns only those ``carried`` are written, all by default.
    """
    parts = shuffle_partitions(df.sparkSession)
    ranged = (
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    frozen = materialise(ranged if carried is None else ranged.select(*carried, "_mid"), "ordered")
    return frozen.withColumns(
        {
            "_slot": F.shiftright("_mid", 33),
            "_in_slot": F.col("_mid").bitwiseAND(F.lit(_IN_PARTITION)),
        }
    ).drop("_mid")


def _join_offsets(slots: DataFrame, totals: pd.DataFrame, names: Sequence[str]) -> DataFrame:
    """Attach exclusive running totals per slot (one row per sorted partition)."""
    totals = totals.sort_values("_slot")
    for name in names:
        totals[f"_before_{name}"] = totals[name].cumsum() - totals[name]
    offsets = slots.sparkSession.createDataFrame(
        totals[["_slot", *[f"_before_{n}" for n in names]]]
    )
    return slots.join(F.broadcast(offsets), "_slot")


def number_rows(
    df: DataFrame, order_by: Sequence, series: Sequence[str] = (), pos: str = "row_id", carried: Sequence[str] | None = None
) -> tuple[DataFrame, int]:
    """Add the 0-based position in ``order_by`` (per series if given); also return the row count.

    ``carried`` names the columns that are needed after the sort (those of the series among them); all by default.
    """
    slots = _sorted_slots(df, [*series, *order_by], carried)
    counts = slots.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n")).toPandas()
    total = int(counts["_n"].sum())
    if total == 0:
        return slots.drop("_slot", "_in_slot").withColumn(pos, F.lit(0).cast("bigint")), 0
    out = (
        _join_offsets(slots, counts, ["_n"])
        .withColumn(pos, F.col("_before__n") + F.col("_in_slot"))
        .drop("_slot", "_in_slot", "_before__n")
    )
    if series:
        first = out.groupBy(*series).agg(F.min(pos).alias("_first"))
        out = join_series(out, first, series, total).withColumn(pos, F.col(pos) - F.col("_first")).drop("_first")
    return out, total


def with_position(
    df: DataFrame, order_by: Sequence, series: Sequence[str] = (), pos: str = "row_id"
) -> DataFrame:
    return number_rows(df, order_by, series, pos)[0]


def prefix_sums(df: DataFrame, order_by: Sequence, sums: dict[str, str]) -> DataFrame:
    """Inclusive running totals ``{new column: numeric column}`` along ``order_by``."""
    slots = _sorted_slots(df, order_by)
    per_slot = slots.groupBy("_slot").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).toPandas()
    if per_slot.empty:
        return slots.drop("_slot", "_in_slot").select("*", *[F.lit(0).alias(n) for n in sums])
    # running totals only inside a slot, so no task ever holds more than one range partition
    w = Window.partitionBy("_slot").orderBy("_in_slot").rowsBetween(Window.unboundedPreceding, 0)
    joined = _join_offsets(slots, per_slot, list(sums))
    return joined.select(
        *df.columns,
        *[(F.sum(c).over(w) + F.col(f"_before_{n}")).alias(n) for n, c in sums.items()],
    )


def running_totals(df: DataFrame, n: int, sums: dict[str, str], pos: str = "row_id") -> DataFrame:
    """Inclusive running totals of a table that already has dense positions ``pos``.

    Nothing is sorted globally: totals per block are small, their own running
    totals (by the same method while there are many blocks) become offsets, and
    a window inside each block adds the rest.
    """
    size = block_rows(df.sparkSession, n, 0)
    blocks = -(-max(n, 1) // size)
    with_block = df.withColumn("_block", F.floor(F.col(pos) / size))
    per_block = with_block.groupBy("_block").agg(*[F.sum(c).alias(f"_sum_{c}") for c in set(sums.values())])
    inclusive = {f"_upto_{c}": f"_sum_{c}" for c in set(sums.values())}
    if blocks > DRIVER_BLOCKS:
        nested = running_totals(per_block.withColumnRenamed("_block", "_nth"), blocks, inclusive, "_nth")
        offsets = nested.select(
            F.col("_nth").alias("_block"), *[(F.col(f"_upto_{c}") - F.col(f"_sum_{c}")).alias(f"_before_{c}") for c in set(sums.values())]
        )
    else:
        totals = per_block.toPandas().sort_values("_block")
        for c in set(sums.values()):
            totals[f"_before_{c}"] = totals[f"_sum_{c}"].cumsum() - totals[f"_sum_{c}"]
        keep = totals[["_block", *[f"_before_{c}" for c in set(sums.values())]]]
        schema = T.StructType(
            [T.StructField("_block", T.LongType())]
            + [
                T.StructField(f"_before_{c}", per_block.schema[f"_sum_{c}"].dataType)
                for c in set(sums.values())
            ]
        )
        offsets = F.broadcast(df.sparkSession.createDataFrame(keep, schema))
    w = Window.partitionBy("_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return with_block.join(offsets, "_block").select(
        *df.columns, *[(F.sum(c).over(w) + F.col(f"_before_{c}")).alias(new) for new, c in sums.items()]
    )


def block_rows(spark, n: int, halo: int) -> int:
    """Rows per block: enough blocks for the cluster, halo at most a quarter of a block."""
    share = -(-max(n, 1) // (2 * parallelism(spark)))
    return max(min(max(share, MIN_BLOCK), MAX_BLOCK), 4 * halo)


def replicate_to_blocks(
    df: DataFrame, size: int, before: int, after: int, pos: str = "row_id"
) -> DataFrame:
    """Copy each row into every block (``_block``) whose frames reach it."""
    low = F.greatest(F.floor((F.col(pos) - after) / size), F.lit(0))
    high = F.floor((F.col(pos) + before) / size)
    return df.withColumn("_block", F.explode(F.sequence(low, high)))


def over_blocks(
    df: DataFrame,
    n: int,
    exprs: dict[str, Callable[[Window], Column]],
    before: int,
    after: int = 0,
    series: Sequence[str] = (),
    pos: str = "row_id",
    size: int | None = None,
) -> DataFrame:
    """Evaluate windowed expressions whose frames reach ``before``/``after`` rows.

    Each callable receives the ordered window of its block and returns a column.
    """
    size = size or block_rows(df.sparkSession, n, before + after)
    w = Window.partitionBy(*series, "_block").orderBy(pos)
    wide = replicate_to_blocks(df, size, before, after, pos)
    return (
        wide.withColumns({name: make(w) for name, make in exprs.items()})
        .where(F.col("_block") == F.floor(F.col(pos) / size))
        .drop("_block")
    )


def pack_blocks(
    df: DataFrame,
    n: int,
    values: Column,
    before: int,
    after: int = 0,
    pos: str = "row_id",
    size: int | None = None,
) -> tuple[DataFrame, int]:
    """One row per block: ``_block``, sorted positions ``at`` and their values ``v``.

    A block holds at most ``size + before + after`` rows whatever the data is.
    """
    size = size or min(block_rows(df.sparkSession, n, before + after), 8192)
    size = max(size, before + after)
    slim = df.select(pos, values.alias("v"))
    packed = (
        replicate_to_blocks(slim, size, before, after, pos)
        .repartition(shuffle_partitions(df.sparkSession), "_block")
        .groupBy("_block")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("at"), "v"))).alias("rows"))
        .where(F.col("_block") <= (max(n, 1) - 1) // size)
        .select("_block", F.col("rows.at").alias("at"), F.col("rows.v").alias("v"))
    )
    return packed, size
