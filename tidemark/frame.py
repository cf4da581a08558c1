"""The feature table every detector works on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import number_rows


@dataclass(frozen=True)
class Frame:
    """``df`` holds ``row_id`` (0-based position), the features and maybe a timestamp."""

    df: DataFrame
    features: tuple[str, ...]
    n: int
    ts: str | None = None

    @staticmethod
    def of(df: DataFrame, features: Sequence[str], order_by: Sequence[str], ts: str | None = None) -> "Frame":
        """Number the rows along ``order_by``, which must be a total order."""
        extra = [ts] if ts and ts not in features else []
        keys = [c for c in order_by if c not in features and c not in extra]
        slim = df.select(*keys, *extra, *features)
        placed, n = number_rows(slim, order_by, carried=[*extra, *features])
        return Frame(placed.select("row_id", *extra, *features), tuple(features), n, ts)

    def with_df(self, df: DataFrame, features: Sequence[str] | None = None) -> "Frame":
        return replace(self, df=df, features=tuple(features or self.features))

    def vector(self):
        """Features as one ARRAY<DOUBLE> column."""
        return F.array(*[F.col(c).cast("double") for c in self.features])
