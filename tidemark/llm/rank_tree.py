"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding.

A leaf of the tree is a symbol with its right neighbour: the rank of that pair's merge, then its position, in
one integer; a pair without a merge is infinite.  An inner node is the smaller of its children, so the root is
the leftmost pair of the lowest rank.  A merge changes three leaves (the merged pair, the one before it, and the
swallowed symbol), each in logarithmic time, until the root is infinite.

Words of up to 65 symbols are merged many at a time, a row of one array for each tree; longer ones one by one,
so a word of n symbols costs n log n whatever its length.  A worker remembers the words it has met, up to a bound.

The vocabulary file says how texts are normalised and cut.  Characters below U+0180 need no composition and are
cut here; a stretch between white space that holds any other goes through the library's own normaliser and
pre-tokeniser, so both follow the installed tables of Unicode.  White space always ends a word, so a long text is
taken in pieces that end at it.

Defined results: NULL and empty texts have no ids and decode to ''.  The strings of added tokens in a text are
those tokens.  Every row is taken by itself: repeated rows give repeated rows, ids may be NULL or tie, and
columns other than ``doc_id`` and ``text`` are not looked at.  An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.words import ranges

PIECE = 1 << 18  # characters of a text taken at once
WORDS = 300_000  # words a worker remembers before it starts anew
IDS = 1 << 20  # ids in one batch of rows, but for a longer row
_ROW = 64  # leaves of the widest tree that shares an array with others
_CELLS = 1 << 20  # nodes of trees worked on at once
_AT = 32  # bits of a position below the rank
_NONE = np.int64((1 << 62) - 1)

_PLAIN = 0x180  # lower case stays below, but for the dot over i, which is no letter
_SPACE = "".join(chr(c) for c in range(_PLAIN) if chr(c).isspace() and not 0x1C <= c <= 0x1F)


def _class(kind: str) -> str:
    """Characters below U+0180 of a general category, for use inside brackets."""
    return "".join(re.escape(chr(c)) for c in range(_PLAIN) if unicodedata.category(chr(c))[0] == kind)


#: Fixed value: how words are cut, written for characters below U+0180.
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{re.escape(_SPACE)}{_class('L')}{_class('N')}]+")
_STRETCH = re.compile(f"[^{re.escape(_SPACE)}]+")
_GAP = re.compile(f"[{re.escape(_SPACE)}]")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in the file: itself where it is printable Latin-1, else from U+0100 on."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Merges:
    """What the file says: ids of bytes, and of each mergeable pair its rank and what it becomes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that look at their neighbours are not supported")
        self.tokens = [""] * (1 + max(chain(vocab.values(), self.added.values())))
        for token, i in chain(vocab.items(), self.added.items()):
            self.tokens[i] = token
        letters = _byte_letters()
        self.letter_byte = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])  # a pair named twice has its first rank
        self.keys, self.ranks = keys[first], order[first].astype(np.int64)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf of each pair at its position; symbols below 0 are none."""
        key = left << 32 | right
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[slot] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[slot] << _AT | at, _NONE)


def merge_many(symbols: np.ndarray, merges: Merges) -> np.ndarray:
    """Merge rows of symbols (-1 fills up); what is swallowed becomes -1, so the rest reads in order."""
    rows, width = symbols.shape
    wide = 1 << max(width - 2, 0).bit_length()  # leaves: a pair for each symbol but the last
    end = width  # no such symbol
    sym = np.full((rows, width + 1), -1, np.int64)
    sym[:, :width] = symbols
    after = np.broadcast_to(np.arange(1, width + 2), (rows, width + 1)).copy()
    after[:, :width][sym[:, 1:] < 0] = end
    before = np.broadcast_to(np.arange(-1, width), (rows, width + 1)).copy()
    before[:, 0] = end
    tree = np.full((rows, 2 * wide), _NONE)
    at = np.arange(width - 1)
    tree[:, wide: wide + width - 1] = merges.leaves(sym[:, : width - 1], sym[:, 1: width], at[None, :])
    level = wide
    while level > 1:
        tree[:, level // 2: level] = np.minimum(tree[:, level: 2 * level: 2], tree[:, level + 1: 2 * level: 2])
        level //= 2
    sym, after, before, tree = sym.ravel(), after.ravel(), before.ravel(), tree.ravel()
    row = np.arange(rows)
    while True:
        best = tree[row * (2 * wide) + 1]
        alive = best < _NONE
        row, best = row[alive], best[alive]
        if not len(row):
            return sym.reshape(rows, width + 1)[:, :width]
        base, at = row * (width + 1), best & ((1 << _AT) - 1)
        gone = after[base + at]
        right, left = after[base + gone], before[base + at]
        sym[base + at] = merges.made[best >> _AT]
        sym[base + gone] = -1
        after[base + at] = right
        before[base + right] = at  # of no symbol: written beside the row, never read
        merged = sym[base + at]
        leaf = np.concatenate([at, left, gone])
        value = np.concatenate([
            merges.leaves(merged, sym[base + right], at), merges.leaves(sym[base + left], merged, left), np.full(len(row), _NONE),
        ])
        held = leaf < min(wide, end)
        top = np.concatenate([row, row, row])[held] * (2 * wide)
        node = leaf[held] + wide
        tree[top + node] = value[held]
        for _ in range(wide.bit_length() - 1):
            node >>= 1
            tree[top + node] = np.minimum(tree[top + 2 * node], tree[top + 2 * node + 1])


def merge_one(symbols: list[int], merges: Merges) -> list[int]:
    """Merge one long word by a tree of its own."""
    n = len(symbols)
    wide = 1 << max(n - 2, 0).bit_length()
    none, rank_of, made = int(_NONE), merges.rank_of, merges.made
    tree = [none] * (2 * wide)

    def leaf(i: int, j: int) -> int:
        rank = rank_of.get(symbols[i] << 32 | symbols[j])
        return none if rank is None else rank << _AT | i

    for i in range(n - 1):
        tree[wide + i] = leaf(i, i + 1)
    for node in range(wide - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        node = wide + i
        tree[node] = value
        while node > 1:
            node >>= 1
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:  # nothing changes further up
                return
            tree[node] = low

    while tree[1] < none:
        rank, at = tree[1] >> _AT, tree[1] & ((1 << _AT) - 1)
        gone = after[at]
        right, left = after[gone], before[at]
        symbols[at], symbols[gone] = int(made[rank]), -1
        after[at] = right
        if right < n:
            before[right] = at
        if gone < n - 1:
            put(gone, none)
        put(at, leaf(at, right) if right < n else none)
        if left >= 0:
            put(left, leaf(left, at))
    return [s for s in symbols if s >= 0]


class TreeEncoder:
    """Ids of texts, with a bounded memory of words."""

    def __init__(self, path: str):
        self.merges = _merges(path)
        self.library = Tokenizer.from_file(path)
        self.odd: dict[str, list[str]] = {}
        added = sorted(self.merges.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self._clear()

    def _clear(self) -> None:
        self.number = {w: k for k, w in enumerate(self.merges.added)}  # their own words, never cut further
        self.ids = np.array(list(self.merges.added.values()), np.int64)
        self.start = np.arange(len(self.number))
        self.size = np.ones(len(self.number), np.int64)

    def _stretch(self, text: str) -> list[str]:
        """Words between white space when some character is not below U+0180."""
        if text not in self.odd:
            if len(self.odd) >= WORDS:
                self.odd = {}
            cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            self.odd[text] = [bytes(self.merges.letter_byte[c] for c in word).decode() for word, _ in cut]
        return self.odd[text]

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        if text.isascii() or ord(max(text)) < _PLAIN:
            return _WORD.findall(text.lower())
        out: list[str] = []
        for s in _STRETCH.findall(text):
            out += _WORD.findall(s.lower()) if s.isascii() or ord(max(s)) < _PLAIN else self._stretch(s)
        return out

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Words of a text, piece by piece; pieces end before white space."""
        at = 0
        while at < len(text):
            gap = _GAP.search(text, at + PIECE) if at + PIECE < len(text) else None
            until = gap.start() if gap else len(text)
            part = text[at: until]
            if self.cut is None or not any(a in part for a in self.merges.added):
                yield self._words(part)
            else:
                yield list(chain.from_iterable([s] if s in self.merges.added else self._words(s) for s in self.cut.split(part)))
            at = until

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw])
        ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(raw)
        for limit in [1, *(1 + (1 << k) for k in range(_ROW.bit_length()))]:
            low = 0 if limit == 1 else 1 if limit == 2 else 1 + (limit - 1) // 2
            mine = np.flatnonzero((sizes > low) & (sizes <= limit))
            per = max(1, _CELLS // (2 * limit))
            for lot in (mine[k: k + per] for k in range(0, len(mine), per)):
                held = sizes[lot]
                data = np.frombuffer(b"".join(raw[k] for k in lot), np.uint8)
                ends = np.cumsum(held)
                symbols = np.full((len(lot), limit), -1, np.int64)
                inside = np.arange(limit)[None, :] < held[:, None]
                symbols[inside] = self.merges.inner[data]
                symbols[np.arange(len(lot)), held - 1] = self.merges.last[data[ends - 1]]
                if limit > 1:
                    symbols = merge_many(symbols, self.merges)
                kept = symbols >= 0
                flat, cuts = symbols[kept], np.cumsum(kept.sum(1))[:-1]
                for k, found in zip(lot, np.split(flat, cuts)):
                    ids[k] = found
        for k in np.flatnonzero(sizes > 1 + _ROW):
            data = np.frombuffer(raw[k], np.uint8)
            symbols = self.merges.inner[data]
            symbols[-1] = self.merges.last[data[-1]]
            ids[k] = np.array(merge_one(symbols.tolist(), self.merges), np.int64)
        size = np.array([len(i) for i in ids], np.int64)
        self.number |= zip(words, range(len(self.start), len(self.start) + len(words)))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *ids])

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, how many of them each text has) for lots of texts in order."""
        held: list[np.ndarray] = []
        counts: list[int] = []
        lot: list[list[str]] = []
        chars = 0

        def work() -> list[np.ndarray]:
            words = list(chain.from_iterable(lot))
            new = list(dict.fromkeys(w for w in words if w not in self.number))
            if len(self.number) + len(new) > WORDS:
                self._clear()
                new = [w for w in dict.fromkeys(words) if w not in self.number]
            if new:
                self._learn(new)
            at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
            sizes = self.size[at]
            ids = self.ids[ranges(self.start[at], self.start[at] + sizes)]
            ends = np.cumsum(np.concatenate([[0], sizes]))[np.cumsum([0, *map(len, lot)])]
            lot.clear()
            return np.split(ids, ends[1:-1])

        owner: list[int] = []
        for k, text in enumerate(texts):
            for words in self.pieces(text or ""):
                lot.append(words)
                owner.append(k)
                chars += sum(map(len, words))
                if chars >= PIECE:
                    held += work()
                    chars = 0
            if k + 1 == len(texts) or sum(map(len, held)) >= IDS:
                held += work() if lot else []
                chars = 0
                first = len(counts)
                counts_now = np.bincount(np.array(owner, np.int64) - first, [len(h) for h in held], minlength=k + 1 - first).astype(np.int64)
                counts += counts_now.tolist()
                yield np.concatenate([np.zeros(0, np.int64), *held]), counts_now
                held, owner = [], []


@functools.lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, token_ids (array of int) of every row's whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = TreeEncoder(path)
        for batch in batches:
            at = 0
            for ids, counts in encoder.encode(batch.column("text").to_pylist()):
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(counts)), lists], ["doc_id", "token_ids"])
                at += len(counts)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, token_ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, token_ids, decoded: the tokens of the ids, joined by one space as the library joins them without a decoder.

    An id the vocabulary lacks is passed over; NULL ids give ''.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tokens = _merges(path).tokens
        known = np.array([t != "" for t in tokens])
        for batch in batches:
            column = batch.column("token_ids")
            lists = column.fill_null([]) if column.null_count else column
            low = 0
            while low < len(batch):
                total, high = 0, low
                while high < len(batch) and (high == low or total + len(lists[high]) <= IDS):
                    total += len(lists[high])
                    high += 1
                texts = []
                for k in range(low, high):
                    ids = lists[k].values.to_numpy(zero_copy_only=False)
                    ids = ids[(ids >= 0) & (ids < len(tokens))]
                    texts.append(" ".join(map(tokens.__getitem__, ids[known[ids]].tolist())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), column.slice(low, high - low), pa.array(texts, pa.string())],
                    ["doc_id", "token_ids", "decoded"],
                )
                low = high

    return encoded.select("doc_id", "token_ids").mapInArrow(run, f"doc_id {kind}, token_ids array<int>, decoded string")


def coded_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text, one row per row of ``docs``."""
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return decode(encode(docs, path), path).select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
