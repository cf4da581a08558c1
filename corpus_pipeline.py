"""From raw documents to packed training sequences: five stages, each one operator of tidemark.llm.

A stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame,
which is written as Parquet and read again for the next stage.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.jaccard_join import keep_one
from tidemark.llm.language_id import held_out, keep_identified, learn
from tidemark.llm.packing import pack, token_pieces
from tidemark.llm.pii import replace_personal_data
from tidemark.llm.queries import SURROGATE_KEY, table, tokenizer
from tidemark.session import discard, disposable, materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts that are NULL, empty, without letters or in no learned language go."""
    return keep_identified(docs, learn(docs.where(~held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by 5-word shingles at a Jaccard similarity of 0.8."""
    return keep_one(docs, n=5, share=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars follows the text."""
    clean = replace_personal_data(docs, SURROGATE_KEY)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their ids and their place in sequences of 1024 tokens."""
    pieces = token_pieces(docs, tokenizer()).withColumn("ids_crc32", F.crc32("ids"))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL expresses neither the filters of n-grams nor keyed surrogates nor the tokenizer; tests/llm checks the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with disposable(spark) as keep:
            kept = keep(materialise(stage(spark, docs, sf_dir), f"stage-{name}"))
        if hasattr(docs, "written_to"):
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
