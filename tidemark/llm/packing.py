"""Best-two-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import BatchEncoder
from tidemark.session import materialise

PIECES = "doc_id long, piece int, start long, length long, ids binary, _part int, _rank long"
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids", pa.binary()), ("_part", pa.int32()), ("_rank", pa.int64()),
])


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``length`` ids (little-endian 32-bit in ``ids``), written once.

    Every document ends with ``end_id``; NULL or empty text is that id alone.  A document of more than
    ``length`` ids is cut so that only its first piece may be shorter.  ``_rank`` numbers the pieces of each
    length within the task ``_part``.
    """

    def cut(batches):
        encoder = BatchEncoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            doc_ids = batch.column(0)
            for low, high, ids, edges in encoder.encode(batch.column(1)):
                # put the end id behind each document
                edges = edges + np.arange(len(edges))
                whole = np.empty(edges[-1], "<u4")
                last = np.zeros(edges[-1], bool)
                last[edges[1:] - 1] = True
                whole[last], whole[~last] = end_id, ids
                sizes = np.diff(edges)
                n = -(-sizes // length)
                doc = np.repeat(np.arange(high - low), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = sizes - (n - 1) * length
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * length)
                size = np.where(piece == 0, head[doc], length)
                # place among the pieces of the same length
                order = np.argsort(size, kind="stable")
                ordered = size[order]
                rank = np.empty(len(size), np.int64)
                rank[order] = np.arange(len(size)) - np.searchsorted(ordered, ordered) + seen[ordered]
                seen += np.bincount(size, minlength=length + 1)
                raw = whole.tobytes()
                at = 4 * (edges[doc] + start)
                blobs = [raw[a: a + 4 * s] for a, s in zip(at.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(low, high - low).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size),
                        pa.array(blobs, pa.binary()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(rank),
                    ],
                    schema=_PIECES,
                )

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return materialise(rows.mapInArrow(cut, PIECES), "pieces")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many bins look like that) for so many pieces of each length.

    A bin is filled greedily with the largest piece that fits its gap.  Then its smallest piece may give way
    to two unpacked pieces that fill the gap and the freed room further.  The bin found is repeated as often
    as the pieces left allow, so the work depends on the number of different lengths and not of pieces.
    """
    left = dict(counts)
    sizes = sorted(s for s, n in left.items() if n)
    plan: list[tuple[list[int], int]] = []

    def available(size: int, held: list[int]) -> int:
        return left[size] - held.count(size)

    def largest(limit: int, held: list[int]) -> int | None:
        at = bisect.bisect_right(sizes, limit) - 1
        while at >= 0 and available(sizes[at], held) <= 0:
            at -= 1
        return sizes[at] if at >= 0 else None

    def best_two(room: int, least: int, held: list[int]) -> tuple[int, int] | None:
        best, pair = least, None
        for a in reversed(sizes[: bisect.bisect_right(sizes, room - 1)]):
            if 2 * a <= best:  # the second is no larger than the first
                break
            if available(a, held) <= 0:
                continue
            b = largest(min(a, room - a), [*held, a])
            if b is not None and a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
        return pair

    while sizes:
        held: list[int] = []
        gap = capacity
        while gap and (size := largest(gap, held)) is not None:
            held.append(size)
            gap -= size
        if gap and held:
            smallest = held[-1]
            pair = best_two(gap + smallest, smallest, held[:-1])
            if pair is not None:
                held[-1:] = pair
        times = min(left[s] // held.count(s) for s in set(held))
        plan.append((held, times))
        for s in set(held):
            left[s] -= times * held.count(s)
            if not left[s]:
                sizes.remove(s)
    return plan


def _slots(plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Table by (length, rank from): bins from, uses of the length in a bin, where its places are listed."""
    taken: dict[int, int] = {}
    rows, places, bins = [], [], 0
    for held, times in plan:
        offsets = np.cumsum([0, *held[:-1]])
        for size in sorted(set(held)):
            mine = [int(o) for o, s in zip(offsets, held) if s == size]
            rows.append((size, taken.get(size, 0), bins, len(mine), len(places)))
            places += mine
            taken[size] = taken.get(size, 0) + times * len(mine)
        bins += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return (*table.T, np.array(places, np.int64))


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (length, _part, _rank and any other columns).

    Only the number of pieces of each length, at most ``capacity`` numbers, is gathered; the plan made from
    it is as bounded.  Each piece then finds its place by its rank among the pieces of its length, which
    comes from its rank in its task and the tasks' counts.  Numbers of sequences are dense, places gapless.
    """
    counted = materialise(pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    counts = {int(r["length"]): int(r["n"]) for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    lengths, ranks, first_bin, uses, where, places = _slots(plan_bins(counts, capacity))
    offsets = _offsets(counted)

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def locate(length: pa.Array, at: pa.Array) -> pa.Array:
        size, rank = length.to_numpy(zero_copy_only=False), at.to_numpy(zero_copy_only=False)
        # the last entry of this length that begins at or before the rank
        low, high = np.searchsorted(lengths, size, "left"), np.searchsorted(lengths, size, "right")
        while (open_ := high - low > 1).any():
            middle = (low + high) // 2
            up = open_ & (ranks[np.minimum(middle, len(ranks) - 1)] <= rank)
            low, high = np.where(up, middle, low), np.where(open_ & ~up, middle, high)
        step = rank - ranks[low]
        sequence = first_bin[low] + step // uses[low]
        offset = places[where[low] + step % uses[low]]
        return pa.StructArray.from_arrays([pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["sequence_id", "offset"])

    kept = [c for c in pieces.columns if c not in ("_part", "_rank")]
    ranked = pieces.join(offsets, ["_part", "length"]).withColumn("_place", locate(F.col("length"), F.col("_rank") + F.col("_before")))
    return ranked.select(*kept, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def _offsets(counted: DataFrame) -> DataFrame:
    """(_part, length, _before): two levels, so that no task sees every part of a length at large scale."""
    block = F.floor(F.col("_part") / 1024)
    rows = counted.withColumn("_block", block)
    sums = rows.groupBy("length", "_block").agg(F.sum("_n").alias("_s"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("length", "_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums, ["length", "_block"]).select(
        "_part", "length", (F.col("_base") + F.coalesce(F.sum("_n").over(inner), F.lit(0))).alias("_before")
    )


def packed_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    pieces = token_pieces(docs, tokenizer)
    narrow = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(narrow).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
