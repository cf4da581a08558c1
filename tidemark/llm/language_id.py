"""Language identification by bit-sliced Bloom filters over letter n-grams.

One table of bit masks serves all languages: bit l of a slot belongs to language l's Bloom filter, so one
lookup (the AND of a few slots) tells every language whose filter holds an n-gram.  A text is judged by the
popcount of each language over its n-grams, corrected for the hits that the filter's fill makes by chance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import LOWER, NO_LETTER, pieces, text_bytes
from tidemark.session import materialise

GRAM = 4  # bytes of UTF-8
PROBES = 3
SLOTS_PER_GRAM = 16
LETTERS = np.where(NO_LETTER, np.uint8(32), LOWER)
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """Documents never learned from: a fifth, by the CRC-32 of the id as text (NULL ids count as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram as uint32, row): four bytes inside a word, or with the space before or behind it.

    ASCII letters are lower-cased, other non-letters are spaces, and spaces in a row are one.
    """
    text = np.full(len(data) + len(offsets), 32, np.uint8)  # every row begins and the last one ends with a space
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    text[np.arange(len(data)) + row + 1] = LETTERS[data]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) + 1)
    rows = np.append(rows, max(0, len(offsets) - 2))
    space = text == 32
    keep = np.ones(len(text), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    text, rows, space = text[keep], rows[keep], space[keep]
    n = len(text) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    wide = text.astype(np.uint32)
    codes = wide[:n] | wide[1: n + 1] << 8 | wide[2: n + 2] << 16 | wide[3: n + 3] << 24
    whole = ~(space[1: n + 1] | space[2: n + 2])
    return codes[whole], rows[1: n + 1][whole]


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # slots x words of 64 languages
    chance: np.ndarray  # per language: share of unknown n-grams that its filter claims
    common: int  # the language with most training n-grams

    def hits(self, codes: np.ndarray) -> np.ndarray:
        """Mask words of the languages whose filter holds each n-gram."""
        found = self.table[_slots(codes, len(self.table), 0)]
        for probe in range(1, PROBES):
            found = found & self.table[_slots(codes, len(self.table), probe)]
        return found


def _slots(codes: np.ndarray, n: int, probe: int) -> np.ndarray:
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_FACTORS[probe])
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(_FACTORS[(probe + 1) % 3])
    return (mixed >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)


def _count(batches):
    """(language, n-gram, count), summed over a piece of text before the shuffle."""
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for lang in np.unique(langs):
            data, offsets = text_bytes(batch.column(0).filter(pa.array(langs == lang)))
            for low, high in pieces(offsets, 6 << 20):
                parts = [
                    grams(data[offsets[low + a]: offsets[low + b]], offsets[low + a: low + b + 1] - offsets[low + a])[0]
                    for a, b in pieces(offsets[low: high + 1])
                ]
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"]
                )


def learn(docs: DataFrame, min_share: float = 1e-5, contrast: float = 0.25, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Filters from every row with text and language.

    A language contains an n-gram that makes up at least ``min_share`` of its n-grams and at least
    ``contrast`` times the share it has in the language where it is most frequent.  So each language holds
    at most ``1 / min_share`` n-grams, whatever the size of the corpus: that bounds the model and what
    reaches the driver.
    """
    counts = (
        docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
        .select(F.col(text_col), F.col(lang_col).cast("string"))
        .mapInArrow(_count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .where("n > 1")
    )
    counts = materialise(counts, "gram-counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return LanguageModel([], np.zeros((2, 1), np.uint64), np.zeros(0), 0)
    spark = docs.sparkSession
    known = spark.createDataFrame([(x, i, float(totals[x])) for i, x in enumerate(languages)], "lang string, _l int, _total double")
    shares = counts.join(F.broadcast(known), "lang").select("gram", "_l", (F.col("n") / F.col("_total")).alias("_p")).where(F.col("_p") >= min_share)
    held = shares.groupBy("gram").agg(F.max("_p").alias("_most"), F.collect_list(F.struct("_l", "_p")).alias("_in"))
    held = held.select("gram", F.transform(F.filter("_in", lambda x: x["_p"] >= contrast * F.col("_most")), lambda x: x["_l"]).alias("langs"))
    rows = held.toPandas()
    slots = 1 << max(10, (SLOTS_PER_GRAM * len(rows) - 1).bit_length())
    table = np.zeros((slots, -(-len(languages) // 64)), np.uint64)
    codes = np.repeat(rows["gram"].to_numpy(np.int64).astype(np.uint32), rows["langs"].map(len).to_numpy())
    lang = np.concatenate([np.asarray(x, np.int64) for x in rows["langs"]]) if len(rows) else np.zeros(0, np.int64)
    for probe in range(PROBES):
        np.bitwise_or.at(table, (_slots(codes, slots, probe), lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
    fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return LanguageModel(languages, table, fill**PROBES, max(range(len(languages)), key=lambda i: totals[languages[i]]))


def _has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum((data < 128) & ~NO_LETTER[data])])
    found = np.diff(total[offsets]) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return found


def _judge(m: LanguageModel, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a batch, piece by piece."""
    data, offsets = text_bytes(column)
    names, scores = [], [np.zeros(0)]
    for low, high in pieces(offsets):
        part, edges = data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low]
        best, known = _decide(m, part, edges, _has_letter(column.slice(low, high - low), part, edges))
        names += best.tolist()
        scores.append(known)
    return names, np.concatenate(scores)


def _decide(m: LanguageModel, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n_rows = len(letters)
    if not m.languages:
        return np.full(n_rows, "und", object), np.zeros(n_rows)
    codes, rows = grams(data, offsets)
    n = np.bincount(rows, minlength=n_rows)[:n_rows].astype(float)
    found = m.hits(codes)
    hits = np.stack([
        np.bincount(rows[(found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) > 0], minlength=n_rows)[:n_rows]
        for i in range(len(m.languages))
    ], axis=1)
    fair = np.clip((hits - n[:, None] * m.chance) / (1 - np.minimum(m.chance, 0.99)), 0, None)
    best = np.where(fair.max(axis=1) > 0, fair.argmax(axis=1), m.common)
    score = np.clip(fair[np.arange(n_rows), best] / np.maximum(n, 1), 0, 1)
    return np.where(letters, np.array(m.languages, object)[best], "und"), np.where(letters, score, 0.0)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row from its text alone.

    score: corrected hits of the language over all n-grams of the text, 0 to 1.  ``und`` (score 0) if the
    text is NULL, has no letter, or nothing was learned.  With equal hits the first language by name wins;
    a text with letters but no n-gram of any language gets the one with most training text and score 0.
    NULL and repeated ids are passed through, other columns ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            names, scores = _judge(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["_id", "lang_pred", "score"])

    return rows.mapInArrow(judge, "_id long, lang_pred string, score double").withColumnRenamed("_id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, least_score: float = 0.2, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a language and at least ``least_score`` of its n-grams known in it.

    Only the text goes to Python and only the verdict comes back; the rows wait in the JVM.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(text: pa.Array) -> pa.Array:
        names, scores = _judge(shared.value, text)
        return pa.array((np.array(names, object) != "und") & (scores >= least_score), pa.bool_())

    return docs.where(known(F.col(text_col)))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from four fifths of the labelled rows, predicts all: (doc_id, held_out, lang_pred, score)."""
    model = learn(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
