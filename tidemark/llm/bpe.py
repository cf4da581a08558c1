"""Byte-level BPE ids of whole Arrow batches: every distinct pre-token is encoded once per worker."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken

from tidemark.llm.words import BYTE, _mix, _powers, pieces, ranges, text_bytes

#: Fixed value: the pre-token pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS  # pre-tokens a worker can remember
POOL = 8_000_000  # ids a worker remembers before it starts anew

BLANK, LETTER, NUMBER, OTHER, BREAK, ODD = range(6)
_PLAIN = 0x500  # characters below are classed here; documents with others go to the library whole


def _class(code: int) -> int:
    char = chr(code)
    if char == " ":
        return BLANK
    if char == "\n":
        return BREAK
    if char.isspace() or char == "'" or 0x1C <= code <= 0x1F:
        return ODD
    kind = unicodedata.category(char)
    if kind == "Cn":
        return ODD
    return {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)


_CLASSES = np.array([_class(c) for c in range(_PLAIN)], np.uint8)
_BYTE_CLASSES = np.concatenate([_CLASSES[:128], np.full(128, ODD, np.uint8)])


def _letters_of_bytes() -> dict[str, int]:
    """The vocabulary file writes bytes as characters: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def _encoding(path: str) -> tuple[tiktoken.Encoding, dict[bytes, int]]:
    """The encoding, and the added tokens with their ids."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    added = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
        raise ValueError("added tokens that look at their neighbours are not supported")
    special = {t["content"] for t in spec.get("added_tokens", [])}
    letters = _letters_of_bytes()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), added


class BatchEncoder:
    """Ids of documents.  The strings of added tokens in a text are those tokens, and texts are cut at them.

    Pre-tokens met before are found in a direct-mapped table by their hash; only new ones are encoded, all
    of a piece in one call.  The table and the pool of ids are bounded.
    """

    def __init__(self, path: str):
        self.encoding, self.added = _encoding(path)
        self.find_added = re.compile(b"|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.newline = self.encoding.encode_ordinary("\n")[0]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int32)
        self.size = np.zeros(SLOTS, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(row from, row to, ids as uint32, where each row's ids begin and end) piece by piece."""
        data, offsets = text_bytes(column)
        for low, high in pieces(offsets):
            ids, edges = self._piece(data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low])
            yield low, high, ids, edges

    def _units(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin; a document with unusual characters is one unit."""
        kind = _BYTE_CLASSES[data]
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xC0 + (_PLAIN >> 6)))
        code = ((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
        kind[lead] = kind[lead + 1] = _CLASSES[code]
        gap = (kind == BLANK) | (kind == BREAK)
        first = np.zeros(len(data) + 1, bool)
        first[edges] = True
        first = first[:-1]
        start = first | gap
        start[1:] |= (kind[:-1] == BREAK) | ((kind[:-1] != BLANK) & (kind[1:] != kind[:-1]))
        # an odd character, or two separators in a row, leaves the document to the library
        odd = kind == ODD
        odd[1:] |= gap[1:] & gap[:-1] & ~first[1:]
        if odd.any():
            total = np.concatenate([[0], np.cumsum(odd)])
            whole = (total[edges[1:]] - total[edges[:-1]]) > 0
            start &= ~np.repeat(whole, np.diff(edges)) | first
        return np.flatnonzero(start)

    def _begins(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pre-tokens and added tokens begin; what lies between added tokens is cut like a document of its own."""
        raw = data.tobytes()
        if self.find_added is None or not any(a in raw for a in self.added):
            return self._units(data, edges)
        # a match may not reach over the end of a document
        spans = [(int(a) + m.start(), int(a) + m.end()) for a, b in zip(edges[:-1], edges[1:]) for m in self.find_added.finditer(raw[a:b])]
        low, high = (np.array(x, np.int64) for x in zip(*spans)) if spans else (np.zeros(0, np.int64),) * 2
        begin = self._units(data, np.unique(np.concatenate([edges, low, high])))
        at = np.searchsorted(low, begin, "right") - 1
        inner = (at >= 0) & (begin > low[at]) & (begin < high[at]) if len(low) else np.zeros(len(begin), bool)
        return begin[~inner]

    def _learn(self, raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of these units into the pool: (place, length) of each."""
        texts = [raw[a:b].decode() for a, b in zip(begin.tolist(), end.tolist())]
        # a line break between two units is a pre-token of its own and does not change theirs
        simple = np.array([t != " " and "\n" not in t and t.encode() not in self.added for t in texts], bool) & (end - begin < 200)
        ids = np.array(self.encoding.encode_ordinary("\n".join([t for t, plain in zip(texts, simple) if plain])), np.uint32)
        edges = np.concatenate([[-1], np.flatnonzero(ids == self.newline), [len(ids)]])
        at, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        if simple.any():
            if len(edges) - 1 != int(simple.sum()):
                raise RuntimeError("pre-tokens were not kept apart")
            at[simple], size[simple] = edges[:-1] + 1, np.diff(edges) - 1
        found, filled = [ids], len(ids)
        for i in np.flatnonzero(~simple):
            whole = self.added.get(texts[i].encode())
            found.append(np.array(self.encoding.encode_ordinary(texts[i]) if whole is None else [whole], np.uint32))
            at[i], size[i] = filled, len(found[-1])
            filled += len(found[-1])
        at += self.used
        need = self.used + filled
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(need, 2 * len(self.pool)) - self.used, np.uint32)])
        self.pool[self.used: need] = np.concatenate(found)
        self.used = need
        return at, size

    def _piece(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(edges) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if self.used > POOL:
            self._clear()
        begin = self._begins(data, edges)
        end = np.append(begin[1:], len(data))
        up, down = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[:-1], out=sums[1:])
        keys = _mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)) | np.uint64(1)
        slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != keys)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        if len(missing):
            new, where, inverse = np.unique(keys[missing], return_index=True, return_inverse=True)
            unit = missing[where]
            place, length = self._learn(data.tobytes(), begin[unit], end[unit])
            at[missing], size[missing] = place[inverse], length[inverse]
            into, which = np.unique((new >> np.uint64(64 - SLOT_BITS)).astype(np.int64), return_index=True)
            short = length[which] < 64
            into, which = into[short], which[short]
            self.keys[into], self.at[into], self.size[into] = new[which], place[which], length[which]
        ids = self.pool[ranges(at, at + size)]
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[np.searchsorted(begin, edges)]
