"""Which keys of which documents occur in other documents: the shuffle behind two of the operators.

Every document offers many 64-bit keys, each at a position.  A row per key would make the shuffle the
bottleneck, so a task packs its keys into one binary row per bucket: 32 bits of the key (the bucket holds
further bits), the position and the document.  Keys that meet within a task are settled there, and only
one of their documents goes on to the bucket; so a key held by a third of all documents sends one entry
per flush of a task, not one per document.

Keys are compared by 32 bits and the bucket, plus whatever the caller checks afterwards.  ``exact=True``
keeps all 64 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidemark.session import shuffle_partitions

FLUSH = 1_000_000  # keys a task holds before it packs them
PER_TASK = 3  # buckets for each shuffle partition, taken one after the other

PACKED = "bucket int, done boolean, docs binary, counts binary, places binary, keys binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("done", pa.bool_()), *((c, pa.binary()) for c in ("docs", "counts", "places", "keys"))])
FOUND = "doc_id long, tag long, places binary"
LOT = 1_000_000  # found entries a task holds before it deals them to the shards of documents
_FOUND = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("places", pa.binary())])

Offer = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def gives_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task returns freed memory to the system.

    A Python worker serves one task after the other and would keep the most that any of them had for as long as it lives.
    """

    def outer(batches):
        _give_back()
        yield from run(batches)
        _give_back()

    return outer


def _squeeze(values: np.ndarray) -> bytes:
    """Differences, byte plane by byte plane: small numbers then cost about a byte."""
    delta = np.diff(values.astype(np.int64), prepend=np.int64(0))
    return zstandard.ZstdCompressor(level=1).compress(delta.view(np.uint8).reshape(-1, 8).T.tobytes())


def _expand(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel())


def pack_places(values: np.ndarray) -> bytes:
    return _squeeze(values)


def unpack_places(blob: bytes) -> np.ndarray:
    """Ascending distinct positions of a document."""
    return _expand(blob)


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Number of the run of equal values that each entry lies in."""
    return np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def _settle(keys, ids, docs, earlier: bool):
    """(hit, first): entries whose key has another document here (a smaller one if ``earlier``), and the entries of each key's smallest document.

    ``ids`` orders documents, ``docs`` tells apart those that share an id.
    """
    order = np.argsort(keys, kind="stable")
    run = _runs(keys[order])
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    if not len(starts):
        return np.zeros(0, bool), np.zeros(0, bool)
    low = np.minimum.reduceat(ids[order], starts)
    if earlier:
        hit = ids[order] > low[run]
        first = ~hit
    else:
        least, most = np.minimum.reduceat(docs[order], starts), np.maximum.reduceat(docs[order], starts)
        hit = (least < most)[run]
        first = docs[order] == least[run]
    a, b = np.empty(len(keys), bool), np.empty(len(keys), bool)
    a[order], b[order] = hit, first
    return a, b


def _row(rows: dict[str, list], bucket: int, done: bool, ids, tags, docs, places, keys: bytes) -> None:
    """``docs`` (ascending) point into ``ids`` and ``tags``."""
    cut = np.flatnonzero(np.diff(docs, prepend=-1))
    held = docs[cut]
    rows["bucket"].append(bucket)
    rows["done"].append(done)
    rows["docs"].append(_squeeze(ids[held]) + tags[held].astype(np.uint32).tobytes())
    rows["counts"].append(_squeeze(np.diff(np.append(cut, len(docs)))))
    rows["places"].append(_squeeze(places))
    rows["keys"].append(keys)


def _batches(rows: dict[str, list]) -> Iterator[pa.RecordBatch]:
    if rows["bucket"]:
        batch = pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _PACKED], schema=_PACKED)
        for at in range(0, len(batch), 64):
            yield batch.slice(at, 64)


class _Packer:
    def __init__(self, buckets: int, earlier: bool, exact: bool):
        self.buckets, self.earlier, self.exact = buckets, earlier, exact
        self.held: list[Offer] = []
        self.n = 0

    def add(self, offer: Offer) -> Iterator[pa.RecordBatch]:
        """offer: ids and tags of documents, then for each key its document (ascending), place and the key."""
        self.held.append(offer)
        self.n += len(offer[4])
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        shift = np.cumsum([0, *(len(o[0]) for o in self.held[:-1])])
        ids, tags, places, keys = (np.concatenate([o[i] for o in self.held]) for i in (0, 1, 3, 4))
        docs = np.concatenate([o[2] + s for o, s in zip(self.held, shift)])
        self.held, self.n = [], 0
        hit, first = _settle(keys, ids[docs], docs, self.earlier)
        rows: dict[str, list] = {c: [] for c in _PACKED.names}
        if hit.any():
            # settled here: no bucket needs them, so they are spread by document
            for lot in np.array_split(np.flatnonzero(hit), max(1, int(hit.sum()) // 50_000)):
                _row(rows, int(docs[lot[0]] * 7919 % self.buckets), True, ids, tags, docs[lot], places[lot], b"")
        keep = np.flatnonzero(first)
        bucket = ((keys[keep] >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket.astype(np.int32), kind="stable")
        keep, bucket = keep[order], bucket[order]
        ends = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in np.unique(bucket):
            lot = keep[ends[b]: ends[b + 1]]
            _row(rows, int(b), False, ids, tags, docs[lot], places[lot], (keys[lot] if self.exact else keys[lot].astype(np.uint32)).tobytes())
        yield from _batches(rows)


def _unpack(row: dict, exact: bool):
    counts = _expand(row["counts"])
    n = len(counts)
    tags = np.frombuffer(row["docs"][len(row["docs"]) - 4 * n:], np.uint32).astype(np.int64)
    ids = _expand(row["docs"][: len(row["docs"]) - 4 * n])
    keys = np.frombuffer(row["keys"], np.uint64 if exact else np.uint32)
    return ids, tags, np.repeat(np.arange(n), counts), _expand(row["places"]), keys


def _join(parts: list, columns: tuple[int, ...]) -> list[np.ndarray]:
    """Concatenate unpacked rows: document numbers shifted, then the other columns."""
    shift = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
    return [np.concatenate([p[2] + s for p, s in zip(parts, shift)])] + [np.concatenate([p[i] for p in parts]) for i in columns]


def _deal(found: list, shards: int) -> Iterator[pa.RecordBatch]:
    """Found entries to the shards of their documents, one packed row per shard."""
    if not found:
        return
    docs, ids, tags, places = _join(found, (0, 1, 3))
    rows: dict[str, list] = {c: [] for c in _PACKED.names}
    # rows without id share one id, so the tag counts as well
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ tags.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    shard = (mixed >> np.uint64(32)) % np.uint64(shards)
    shard = shard.astype(np.int64)[docs]
    order = np.lexsort((places, docs, shard))
    docs, places, shard = docs[order], places[order], shard[order]
    for b in np.unique(shard):
        low, high = np.searchsorted(shard, b), np.searchsorted(shard, b, "right")
        _row(rows, int(b), True, ids, tags, docs[low:high], places[low:high], b"")
    yield from _batches(rows)


def _reduce(batches, earlier: bool, exact: bool, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; one bucket is held at a time."""
    bucket, held, found, n = None, [], [], 0

    def settled():
        docs, ids, tags, places, keys = _join(held, (0, 1, 3, 4))
        # the same document may have come in several rows: number the distinct (id, tag)
        pairs = np.empty(len(ids), dtype=[("id", np.int64), ("tag", np.int64)])
        pairs["id"], pairs["tag"] = ids, tags
        distinct, number = np.unique(pairs, return_inverse=True)
        docs = number[docs]
        hit, _ = _settle(keys, distinct["id"][docs], docs, earlier)
        return distinct["id"], distinct["tag"], docs[hit], places[hit], None

    for batch in batches:
        for row in batch.to_pylist():
            if not row["done"] and row["bucket"] != bucket:
                if held:
                    found.append(settled())
                    n += len(found[-1][2])
                bucket, held = row["bucket"], []
            unpacked = _unpack(row, exact)
            (found if row["done"] else held).append(unpacked)
            n += len(unpacked[2]) * row["done"]
            if n >= LOT:
                yield from _deal(found, shards)
                found, n = [], 0
    if held:
        found.append(settled())
    yield from _deal(found, shards)


def _gather(batches) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; one row per document with its distinct places."""
    shard, held = None, []

    def documents():
        docs, ids, tags, places = _join(held, (0, 1, 3))
        ids, tags = ids[docs], tags[docs]
        order = np.lexsort((places, tags, ids))
        ids, tags, places = ids[order], tags[order], places[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (places[1:] != places[:-1])
        ids, tags, places = ids[new], tags[new], places[new]
        cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])) if len(ids) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(ids))
        for at in range(0, len(cut), 10_000):
            a, b = cut[at: at + 10_000], ends[at: at + 10_000]
            blobs = [pack_places(places[x:y]) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(tags[a]), pa.array(blobs, pa.binary())], schema=_FOUND)

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != shard and held:
                yield from documents()
                held = []
            shard = row["bucket"]
            held.append(_unpack(row, True))
    if held:
        yield from documents()


def found_elsewhere(docs: DataFrame, offer: Callable[[pa.RecordBatch], Iterator[Offer]], earlier: bool, exact: bool) -> DataFrame:
    """(doc_id, tag, packed places): keys that another document has too, or one with a smaller id.

    ``offer`` turns a batch of ``docs`` into document ids, tags (below 2**32; they tell apart documents
    that share an id), and for each key its document, place and value.  Documents without a hit are missing.
    """
    parts = shuffle_partitions(docs.sparkSession)

    def pack(batches):
        packer = _Packer(parts * PER_TASK, earlier, exact)
        for batch in batches:
            for offered in offer(batch):
                yield from packer.add(offered)
        yield from packer.flush()

    packed = docs.mapInArrow(gives_back(pack), PACKED)
    dealt = packed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(gives_back(lambda batches: _reduce(batches, earlier, exact, parts * PER_TASK)), PACKED)
    sharded = found.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return sharded.mapInArrow(gives_back(_gather), FOUND)
