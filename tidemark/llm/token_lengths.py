"""Exact histogram of document lengths in tokens, and what its suffix sums answer for every context limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import BatchEncoder
from tidemark.session import materialise

BLOCK = 128  # lengths summed together in the first of two levels


def token_lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of each row, without special tokens; NULL and empty text have none."""

    def count(batches):
        encoder = BatchEncoder(tokenizer)
        for batch in batches:
            for low, high, _, edges in encoder.encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.diff(edges), pa.int64())], names=["_id", "n_tokens"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(count, "_id long, n_tokens long").withColumnRenamed("_id", id_col)


def length_histogram(lengths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n_tokens, n_docs): tasks count first, so a length that half the documents have costs nothing more."""
    return lengths.groupBy(*(by or []), "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(histogram: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per length that occurs, taken as a context limit.

    docs_fitting, tokens_fitting: documents of at most the limit and their tokens.  docs_longer: the others.
    truncated_tokens: tokens left if every document is cut to the limit.  share_fitting: docs_fitting over
    all documents, so the q-quantile of the lengths is the first row with share_fitting >= q.

    Sums run in two levels, first over blocks of 128 lengths and then inside each block, so no task reads
    the whole histogram.  The histogram is written once.  NULL group values form a group; an empty table gives no rows.
    """
    group = list(by or [])
    block = F.floor(F.col("n_tokens") / BLOCK)
    rows = materialise(histogram.withColumn("_block", block), "histogram")
    sums = rows.groupBy(*group, "_block").agg(
        F.sum("n_docs").alias("_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_tokens")
    )
    over_blocks = Window.partitionBy(*group).orderBy(F.col("_block").desc())
    after = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    sums = sums.select(
        *(F.col(c).alias(f"_g_{c}") for c in group), F.col("_block").alias("_b"),
        _sum("_docs", after).alias("_docs_after"), _sum("_tokens", after).alias("_tokens_after"),
        F.sum("_docs").over(whole).alias("_all_docs"), F.sum("_tokens").over(whole).alias("_all_tokens"),
    )
    on = F.col("_block") == F.col("_b")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    inside = Window.partitionBy(*group, "_block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.col("_docs_after") + _sum("n_docs", inside)
    longer_tokens = F.col("_tokens_after") + _sum(F.col("n_docs") * F.col("n_tokens"), inside)
    joined = rows.join(sums, on).withColumns({"docs_longer": longer, "_longer_tokens": longer_tokens})
    return joined.select(
        *group, F.col("n_tokens").alias("context_limit"), "n_docs",
        (F.col("_all_docs") - F.col("docs_longer")).alias("docs_fitting"),
        (F.col("_all_tokens") - F.col("_longer_tokens")).alias("tokens_fitting"),
        "docs_longer",
        (F.col("_all_tokens") - F.col("_longer_tokens") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_tokens"),
        ((F.col("_all_docs") - F.col("docs_longer")) / F.col("_all_docs")).alias("share_fitting"),
    )


def length_quantile(limits: DataFrame, q: float, by: list[str] | None = None) -> DataFrame:
    """(by..., n_tokens): the smallest length that at least a share ``q`` of the documents does not exceed."""
    return limits.where(F.col("share_fitting") >= q).groupBy(*(by or [])).agg(F.min("context_limit").alias("n_tokens"))


def _sum(c: Column | str, window) -> Column:
    return F.coalesce(F.sum(c).over(window), F.lit(0))
