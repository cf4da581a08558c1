"""Many ordered segments (series, or the scores of several models) as one table of dense positions.

Segments are laid one behind the other: a row's place in all is its segment's offset plus its place in the
segment.  So whatever works on the positions of one table (blocks with halos, running totals) serves all
segments in one pass, however many there are and however unequal: blocks are cut through segments, a segment
that holds most of the rows is many blocks, and thousands of short ones share a block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import number_rows, over_blocks, running_totals
from tidemark.operators.skew import join_series
from tidemark.session import materialise


@dataclass(frozen=True)
class Segments:
    """``df`` with the segment's number ``_g``, its rows ``_n`` and the place in all ``_pos``; ``groups``: by..., _g, _n (rows), _offset."""

    df: DataFrame
    groups: DataFrame
    by: tuple[str, ...]
    total: int

    def previous(self, df: DataFrame, columns: dict[str, str], back: int = 1) -> DataFrame:
        """Add ``{new: column}`` of the row ``back`` before in the same segment, else NULL; ``df`` has _g and _pos."""
        return previous_within(df, self.total, columns, back)

    def named(self, df: DataFrame) -> DataFrame:
        """Put the names of the segments in the place of ``_g``; ``df`` is small next to the rows (a row per segment or so)."""
        return self.groups.select(*self.by, "_g").join(df, "_g").drop("_g")


def segment(df: DataFrame, by: Sequence[str], pos: str = "row_id") -> Segments:
    """``pos`` counts from 0 within each segment, without gaps.  NULL is a segment like any other."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    numbered, k = number_rows(sizes, by, pos="_g")
    groups = materialise(
        running_totals(numbered, k, {"_upto": "_n"}, pos="_g").withColumn("_offset", F.col("_upto") - F.col("_n")).drop("_upto"), "segments"
    )
    total = groups.agg(F.sum("_n")).first()[0] or 0
    laid = join_series(df, groups, by, total).withColumn("_pos", F.col("_offset") + F.col(pos)).drop("_offset")
    return Segments(materialise(laid, "laid"), groups, tuple(by), total)


def previous_within(df: DataFrame, n: int, columns: dict[str, str], back: int = 1, pos: str = "_pos") -> DataFrame:
    exprs = {new: (lambda w, c=c: F.lag(c, back).over(w)) for new, c in {**columns, "_before_g": "_g"}.items()}
    held = over_blocks(df, n, exprs, before=back, pos=pos)
    same = F.col("_before_g") == F.col("_g")
    return held.withColumns({new: F.when(same, F.col(new)) for new in columns}).drop("_before_g")


def lags_within(df: DataFrame, n: int, spec: Sequence[tuple[str, int]], pos: str = "_pos") -> tuple[DataFrame, list[str]]:
    """Add ``c_1 .. c_m`` for every (c, m) of ``spec``: values of earlier rows of the same segment, else NULL."""
    reach = max([m for _, m in spec], default=0)
    if not reach:
        return df, []
    names = {f"{c}_{k}": (c, k) for c, m in spec for k in range(1, m + 1)}
    exprs = {new: (lambda w, c=c, k=k: F.lag(c, k).over(w)) for new, (c, k) in names.items()}
    exprs |= {f"_g_{k}": (lambda w, k=k: F.lag("_g", k).over(w)) for k in range(1, reach + 1)}
    held = over_blocks(df, n, exprs, before=reach, pos=pos)
    same = {new: F.when(F.col(f"_g_{k}") == F.col("_g"), F.col(new)) for new, (_, k) in names.items()}
    return held.withColumns(same).drop(*[f"_g_{k}" for k in range(1, reach + 1)]), list(names)
