"""Removal of word passages that an earlier document has, found by difference-cover anchors."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import found_elsewhere, unpack_places
from tidemark.llm.words import Words, inside, pieces, ranges, text_bytes, windows
from tidemark.session import disposable, materialise

#: A perfect difference set: every residue modulo the period is a difference of two of its members.
PERIOD, COVER = 7, (0, 1, 3)
NO_ID = (1 << 63) - 1

RESULT = "_id long, n_words long, n_removed long, kept_text string"



def _batch_words(batch: pa.RecordBatch, column: int = 2):
    """Words of a batch piece by piece, with the rows of the piece."""
    data, offsets = text_bytes(batch.column(column))
    for low, high in pieces(offsets):
        yield low, high, Words(data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low])


def _offer_anchors(window: int):
    size = window - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def offer(batch):
        ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for low, high, words in _batch_words(batch):
            at = inside(words.first, size)
            doc = np.searchsorted(words.first, at, "right") - 1
            place = at - words.first[doc]
            # a document shorter than the window cannot take part
            chosen = cover[place % PERIOD] & (words.counts[doc] >= window)
            at, doc, place = at[chosen], doc[chosen], place[chosen]
            if len(at):
                yield ids[low:high], tags[low:high], doc, place, windows(words.hashes(), size)[at]

    return offer


def _offer_windows(window: int):
    def offer(batch):
        ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        anchors = batch.column(3)
        for low, high, words in _batch_words(batch):
            starts, docs = [], []
            for k in range(low, high):
                first, n = words.first[k - low], words.counts[k - low]
                held = unpack_places(anchors[k].as_py())
                # the window may start up to a period less one before its anchor
                near = np.zeros(n + 1, np.int32)
                np.add.at(near, np.maximum(held - PERIOD + 1, 0), 1)
                np.add.at(near, held + 1, -1)
                at = np.flatnonzero(np.cumsum(near)[: max(0, n - window + 1)])
                starts.append(at + first)
                docs.append(np.full(len(at), k - low))
            starts, docs = np.concatenate(starts), np.concatenate(docs)
            if len(starts):
                yield ids[low:high], tags[low:high], docs, starts - words.first[docs], windows(words.hashes(), window)[starts]

    return offer


def _cut(window: int):
    def cut(batches):
        for batch in batches:
            texts, removed = batch.column(1), batch.column(2)
            out = {"_id": batch.column(0), "n_words": [], "n_removed": [], "kept_text": []}
            for k in range(batch.num_rows):
                words = (texts[k].as_py() or "").encode().split()
                gone = 0
                if removed[k].is_valid:
                    at = unpack_places(removed[k].as_py())
                    flags = np.zeros(len(words), bool)
                    flags[np.unique(ranges(at, at + window))] = True
                    gone = int(flags.sum())
                    words_kept = list(compress(words, ~flags))
                else:
                    words_kept = words
                out["n_words"].append(len(words))
                out["n_removed"].append(gone)
                out["kept_text"].append(b" ".join(words_kept).decode())
            yield pa.RecordBatch.from_arrays([out["_id"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_text"], pa.string())], names=list(out))

    return cut


def remove_repeated_passages(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_words, n_removed, kept_text).

    A word goes if a window of ``window`` consecutive words that covers it also starts in a document with
    a smaller id.  Windows are judged on the input.

    Windows are not hashed at every word.  Anchors of ``window - 6`` words are hashed at the positions of a
    difference cover modulo 7, three of seven: whatever the two alignments are, two equal windows hold an
    equal anchor at a cover position of both.  Only around anchors that two documents share are the full
    windows hashed and compared, which extends every match to its ends.

    Words are runs without the ASCII spaces U+0009 to U+000D and U+0020.  NULL text has no words.  A NULL id
    counts as larger than every id; rows that share an id never cut each other, and are judged one by one
    (told apart by a 32-bit hash of the text).  Documents shorter than the window lose nothing.  Other
    columns are ignored.
    """
    if window <= PERIOD:
        raise ValueError("window must exceed the period of the difference cover")
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
        F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 32)).alias("_tag"),
        F.col(text_col).alias("_text"),
    )
    with disposable(docs.sparkSession) as keep:
        anchors = found_elsewhere(rows, _offer_anchors(window), earlier=False, exact=False)
        anchors = materialise(anchors.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("places").alias("_anchors")), "anchors")
        hot = found_elsewhere(rows.join(anchors, ["_id", "_tag"]).select("_id", "_tag", "_text", "_anchors"), _offer_windows(window), earlier=True, exact=True)
        removed = keep(materialise(hot.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("places").alias("_removed")), "removed"))
    cut = rows.join(removed, ["_id", "_tag"], "left").select("_id", "_text", "_removed").mapInArrow(_cut(window), RESULT)
    return cut.select(F.when(F.col("_id") != NO_ID, F.col("_id")).alias(id_col), "n_words", "n_removed", "kept_text")


def passage_digest(docs: DataFrame) -> DataFrame:
    kept = remove_repeated_passages(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
