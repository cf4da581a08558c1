"""Severity of toxic text by cumulative-link ordinal regression on the words of a text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import NO_LETTER, Words, pieces, row_of, text_bytes
from tidemark.session import disposable, materialise

SAMPLE = 20_000  # labelled rows that the fit sees, about; all of them if there are fewer
FEATURES = 2_000  # words and word beginnings with a weight
BEGINNINGS = (4, 6)  # bytes: inflected and compound forms share them
MIN_G2 = 30.0  # how strongly a word must be tied to the grades: about one in ten million by chance
MIN_DOCS = 3
ROUNDS = 600
PENALTY = 0.02  # squared weights, against the summed log-likelihood


@dataclass
class SeverityModel:
    words: np.ndarray  # sorted word hashes
    weights: np.ndarray  # one per word, shared by all thresholds
    thresholds: np.ndarray  # ascending, one fewer than grades

    def above(self, rows: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k) of ``n`` texts for each threshold k; (rows, which) lists the words each text has."""
        score = np.bincount(rows, weights=self.weights[which], minlength=n)[:n]
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words of letters, lower-cased in ASCII, and of their beginnings."""
    words = Words(data, offsets, NO_LETTER, lower=True)
    rows = row_of(words.first)
    ends = [words.end, *(np.minimum(words.end, words.start + n) for n in BEGINNINGS)]
    salts = [np.uint64(0), *(np.uint64(n) << np.uint64(56) for n in BEGINNINGS)]
    return np.tile(rows, len(ends)), np.concatenate([words.hashes(end) ^ salt for end, salt in zip(ends, salts)])


def _counts(batches):
    """(feature, texts that have it, those graded above 0), summed over a piece before the shuffle."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        high_grade = batch.column(0).to_numpy(zero_copy_only=False) > 0
        for low, high in pieces(offsets):
            rows, hashes = _features(data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low])
            order = np.lexsort((rows, hashes))
            rows, hashes = rows[order], hashes[order]
            new = np.ones(len(rows), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
            rows, hashes = rows[new], hashes[new]
            start = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]) != 0)
            if len(start):
                n = np.diff(np.append(start, len(hashes)))
                k = np.add.reduceat(high_grade[low:high][rows].astype(np.int64), start)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[start].view(np.int64)), pa.array(n), pa.array(k)], names=["word", "n", "k"])


def _known(hashes: np.ndarray, rows: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the vocabulary), each pair once."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    found = vocabulary[at] == hashes
    pairs = np.unique(rows[found] * len(vocabulary) + at[found])
    return pairs // len(vocabulary), pairs % len(vocabulary)


def fit(docs: DataFrame, grades: DataFrame, **options) -> SeverityModel:
    """See ``_fit``; the tables it writes on the way go when the model is there."""
    with disposable(docs.sparkSession):
        return _fit(docs, grades, **options)


def _fit(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, features: int = FEATURES, split: int = 1, id_col: str = "doc_id", text_col: str = "text") -> SeverityModel:
    """Model from ``grades`` (doc_id, grade from 0 on) and the texts of their documents.

    The fit sees about ``sample`` labelled rows, chosen by a hash of the id: that bounds the labels sent to
    every task and the sparse rows sent to the driver, which are few words each because only the
    ``features`` words most strongly tied to the grade are kept.  Several grades of one document count as
    the highest; rows with NULL are not learned from.

    Labels that only say toxic or not have one grade above 0.  ``split`` makes so many of the highest grade:
    its texts are divided evenly by how many telling words they hold.
    """
    rated = grades.where(F.col(id_col).isNotNull() & F.col("grade").isNotNull()).groupBy(id_col).agg(F.max("grade").cast("int").alias("grade"))
    rated = materialise(rated, "grades")
    n, top = rated.agg(F.count(F.lit(1)), F.coalesce(F.max("grade"), F.lit(1))).first()
    share = min(1.0, sample / max(1, n))
    chosen = rated.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = materialise(docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(chosen), id_col).select("grade", text_col), "graded")
    toxic = (F.col("grade") > 0).cast("int")
    rows, high = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(toxic), F.lit(0))).first()
    if not high or high == rows:  # nothing to tell apart: every text gets the only grade seen
        return SeverityModel(np.zeros(0, np.uint64), np.zeros(0), np.full(max(1, top), -30.0 if high else 30.0))
    counted = texts.mapInArrow(_counts, "word long, n long, k long").groupBy("word").agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))
    # only words that speak for a higher grade: a text without any has the base rate
    counted = counted.where((F.col("_n") >= MIN_DOCS) & (F.col("_k") * rows > F.col("_n") * high))
    picked = counted.withColumn("_g2", _g2(F.col("_k"), F.col("_n"), rows, high)).where(F.col("_g2") >= MIN_G2)
    picked = picked.orderBy(F.desc("_g2"), "word").limit(features).select("word")
    vocabulary = np.sort(np.array([r["word"] for r in picked.collect()], np.int64).view(np.uint64))

    def lists(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for low, high_ in pieces(offsets):
                row, word = _features(data[offsets[low]: offsets[high_]], offsets[low: high_ + 1] - offsets[low])
                row, which = _known(word, row, vocabulary)
                edges = pa.array(np.searchsorted(row, np.arange(high_ - low + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high_ - low), pa.ListArray.from_arrays(edges, pa.array(which.astype(np.int32)))], names=["grade", "words"]
                )

    # rows with the same words and grade are one, with a weight
    data = texts.mapInArrow(lists, "grade int, words array<int>").groupBy("grade", "words").agg(F.count(F.lit(1)).alias("n")).toPandas()
    which = np.concatenate([np.asarray(w, np.int64) for w in data["words"]])
    row = np.repeat(np.arange(len(data)), data["words"].map(len).to_numpy())
    grade, count = data["grade"].to_numpy().copy(), data["n"].to_numpy(float)
    highest = grade == grade.max()
    telling = np.bincount(row, minlength=len(data))
    order = np.argsort(telling[highest], kind="stable")
    reached = np.cumsum(count[highest][order]) / count[highest].sum()
    cuts = [telling[highest][order][np.searchsorted(reached, k / split)] for k in range(1, split)]
    grade[highest] += np.searchsorted(np.array(cuts), telling[highest], "left")
    weights, thresholds = _ordinal(row, which, grade, count, len(vocabulary), max(1, int(grade.max())))
    return SeverityModel(vocabulary, weights, thresholds)


def _g2(k: Column, n: Column, rows: int, high: int) -> Column:
    """Likelihood ratio of a 2 x 2 table: word present or not, graded above 0 or not."""
    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    p = high / rows
    rest, k0 = F.lit(float(rows)) - n, F.lit(float(high)) - k
    return 2 * (part(k, n * p) + part(n - k, n * (1 - p)) + part(k0, rest * p) + part(rest - k0, rest * (1 - p)))


def _ordinal(row, which, grade, count, n_words: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Penalised maximum likelihood of P(grade > k) = logistic(weights . words - threshold_k), by Adam."""
    n, total = len(grade), count.sum()
    at_least = np.array([max(1.0, count[grade > k].sum()) for k in range(top)]) / (total + 1)
    thresholds = np.log((1 - at_least) / at_least)
    # the first threshold and the logarithms of the steps to the next ones
    steps = np.log(np.maximum(np.diff(thresholds), 1e-2))
    params = np.concatenate([np.zeros(n_words), thresholds[:1], steps])
    first, second = np.zeros_like(params), np.zeros_like(params)
    penalty = PENALTY / total

    def levels(p):
        return np.cumsum(np.concatenate([p[n_words: n_words + 1], np.exp(p[n_words + 1:])]))

    for step in range(1, ROUNDS + 1):
        cuts = levels(params)
        score = np.bincount(row, weights=params[:n_words][which], minlength=n)
        edges = np.concatenate([np.full((n, 1), -60.0), np.clip(cuts[None, :] - score[:, None], -60, 60), np.full((n, 1), 60.0)], axis=1)
        below = 1 / (1 + np.exp(-edges))
        low, high = below[np.arange(n), grade], below[np.arange(n), grade + 1]
        chance = np.maximum(high - low, 1e-12)
        slope = below * (1 - below)
        d_low, d_high = slope[np.arange(n), grade] / chance, slope[np.arange(n), grade + 1] / chance
        d_score = count * (d_high - d_low) / total  # of the negative log-likelihood
        d_cuts = np.zeros(top + 2)
        np.add.at(d_cuts, grade + 1, -count * d_high / total)
        np.add.at(d_cuts, grade, count * d_low / total)
        d_cuts = d_cuts[1:-1]
        later = np.cumsum(d_cuts[::-1])[::-1]
        gradient = np.concatenate([
            np.bincount(which, weights=d_score[row], minlength=n_words)[:n_words] + penalty * params[:n_words],
            later[:1], later[1:] * np.exp(params[n_words + 1:]),
        ])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params = params - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return params[:n_words], levels(params)


def rate(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic), one row per input row, in one scan.

    severity is the expected grade, p_toxic the probability of a grade above 0, toxic whether it reaches
    one half, grade the number of thresholds that are more likely passed than not.  NULL and empty texts
    have no words and get the base rate; NULL and repeated ids are passed through, other columns ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        m = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for low, high in pieces(offsets):
                rows, hashes = _features(data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low])
                rows, which = _known(hashes, rows, m.words)
                above = m.above(rows, which, high - low)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low), pa.array(above.sum(axis=1)), pa.array(above[:, 0]),
                        pa.array((above >= 0.5).sum(axis=1), pa.int32()), pa.array(above[:, 0] >= 0.5),
                    ],
                    names=["_id", "severity", "p_toxic", "grade", "toxic"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(judge, "_id long, severity double, p_toxic double, grade int, toxic boolean").withColumnRenamed("_id", id_col)


def toxic_grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the ``labels`` table: 1 if toxic, 0 if not."""
    return labels.select("doc_id", F.col("toxic").cast("int").alias("grade"))
