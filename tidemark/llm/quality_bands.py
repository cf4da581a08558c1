"""Quality rules: counting rules, then bands of Zstandard ratios over documents and fixed chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import Words, inside, pieces, row_of, text_bytes, windows

#: (bytes from, least ratio, most ratio) of compressed to raw size at level 3.  Short texts carry the
#: frame's fixed cost and little context, so their band is wide; long prose settles near 0.3 to 0.5.
BANDS = ((0, 0.25, 1.50), (256, 0.30, 0.90), (1024, 0.22, 0.80), (8192, 0.18, 0.75))
CHUNK = 1024  # bytes; what is left behind the last whole chunk is a chunk with the band of its own length
BAD_CHUNKS = 0.2  # more than this share of the bytes in chunks outside their band rejects the text
MIN_WORDS, MAX_REPEAT = 20, 30
WINDOW = 8

RESULT = (
    "_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, bad_chunks double, kept boolean"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE = np.zeros(256, bool)
_LINE[ord("\n")] = True


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[edges])


def _marked(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return hashes + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: Words, hashes: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Words of each document inside windows of ``size`` words that occur twice or more in it."""
    at = inside(words.first, size)
    keys = _marked(windows(hashes, size)[at], row_of(words.first)[at])
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(words.counts), np.int64)
    near = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    starts = at[twice[near] == keys]
    change = np.zeros(len(hashes) + size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return _sums(np.cumsum(change)[: len(hashes)] > 0, words.first)


def repeated_lines(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    lines = Words(data, offsets, _LINE)
    filled = np.searchsorted(words.start, lines.start) < np.searchsorted(words.start, lines.end)
    doc = row_of(lines.first)[filled]
    keys = _marked(lines.hashes()[filled], doc)
    order = np.argsort(keys, kind="stable")
    again = keys[order][1:] == keys[order][:-1]
    return np.bincount(doc[order][1:][again], minlength=len(words.counts))


def _band(size: int) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(BANDS) if size >= least)


def _verdict(raw: memoryview, press: zstandard.ZstdCompressor) -> tuple[float | None, float | None, bool]:
    """(ratio, share of bytes in chunks out of band, inside the bands)."""
    size = len(raw)
    if not size:
        return None, None, False
    fits = lambda ratio, n: (band := _band(n))[0] <= ratio <= band[1]
    ratio = len(press.compress(raw)) / size
    parts = [raw[k: k + CHUNK] for k in range(0, size, CHUNK)]
    bad = sum(len(p) for p in parts if not fits(len(press.compress(p)) / len(p), len(p))) / size
    return ratio, bad, fits(ratio, size) and bad <= BAD_CHUNKS


def _judge(batches):
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for low, high in pieces(offsets):
            part, edges = data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low]
            words = Words(part, edges)
            hashes = words.hashes()
            # code points inside words: bytes that start a character and are no separator
            in_word = np.zeros(len(part) + 1, np.int8)
            in_word[words.start] += 1
            in_word[words.end] -= 1
            head = (part & 0xC0) != 0x80
            chars = _sums(head & (np.cumsum(in_word[:-1], dtype=np.int8) > 0), edges)
            repeat = repeated_words(words, hashes)
            n = words.counts
            failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT * n)
            raw = memoryview(np.ascontiguousarray(part)).cast("B") if len(part) else memoryview(b"")
            verdicts = [_verdict(raw[a:b], press) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(low, high - low), pa.array(n, pa.int64()), pa.array(chars, pa.int64()),
                    pa.array(_sums(_SYMBOL[part], edges), pa.int64()), pa.array(repeated_lines(part, edges, words), pa.int64()),
                    pa.array(repeat, pa.int64()), pa.array(failed), pa.array([v[0] for v in verdicts], pa.float64()),
                    pa.array([v[1] for v in verdicts], pa.float64()), pa.array(~failed & np.array([v[2] for v in verdicts], bool)),
                ],
                names=["_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "bad_chunks", "kept"],
            )


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict, one row per input row, in one scan without a shuffle.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in 8-word windows that the text holds
    twice or more.  ``ratio`` is compressed to raw size of the UTF-8 text, ``bad_chunks`` the share of its bytes
    that lie in chunks of ``CHUNK`` bytes (the last one shorter) outside the band of the chunk's length.  ``kept``
    needs the base rules, the ratio inside the band of the text's length, and at most a fifth of the bytes in
    chunks out of band: repetitive text lies below the bands, encoded or random text above.

    NULL and empty text count as no words, fail the base rules and have NULL ratios.  NULL or repeated ids
    are passed through; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_judge, RESULT).withColumnRenamed("_id", id_col)
