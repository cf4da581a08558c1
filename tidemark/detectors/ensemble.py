"""Combining the scores of several models per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("average", "max", "median", "weighted")


def combine(scores: DataFrame, method: str = "average", weights: dict[str, float] | None = None) -> DataFrame:
    """``scores`` is long (row_id, model, score); an unknown method averages.

    Models that failed have no rows and are skipped.
    """
    if method == "weighted" and weights:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        w = F.coalesce(F.try_element_at(table, F.col("model")), F.lit(0.0))
        total = F.sum(w)
        agg = F.when(total > 0, F.sum(w * F.col("score")) / total)
    else:
        agg = {"max": F.max, "median": F.median}.get(method, F.avg)("score")
    return scores.groupBy("row_id").agg(agg.alias("score"))
