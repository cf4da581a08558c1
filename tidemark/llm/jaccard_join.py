"""Exact n-gram Jaccard join that skips work between related sets.

Documents are sets of hashed word n-grams.  Three steps, each exact:

1. Sets that are equal become one.  Of the others, only those stay whose smallest n-grams are shared often
   enough to leave room for a partner (a counting prefix filter).
2. Index lists: for every n-gram of a set's prefix, the list of sets that have it, ordered by size and
   position.  A list is walked in blocks; a block is skipped if the sizes and positions in it rule out the
   overlap a link needs.  What remains is not a pair for every candidate but a forest that connects them,
   and so the clusters in which all links lie.
   A cluster that is too large for one block is often held together by chance n-grams of long sets.  Its sets are
   compared again by bitmaps about as long as they are, which leaves little but links, before n-grams travel.
3. Sets meet inside their cluster in bounded blocks.  A set's overlaps with the whole block are derived from
   the computed overlaps of a very similar set: only the n-grams that one of the two lacks are looked up.
   Again a forest of true links goes out, which has the same components as all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import found_elsewhere, gives_back, unpack_places
from tidemark.llm.words import Words, inside, pieces, ranges, row_of, text_bytes, windows
from tidemark.operators.components import components
from tidemark.operators.order import number_rows
from tidemark.operators.skew import join_unique
from tidemark.session import disposable, materialise, shuffle_partitions, small_batches

PARITY = 4  # 64-bit words of a set's parity bitmap
LIST_BLOCK = 1024  # sets of an index list compared at once
SHORT_LIST = 8  # lists of up to so many sets are compared together with others
HOT_SHARE = 1000  # an n-gram in more than one of so many sets is ordered last and has no list
BLOCK_TOKENS = 1_000_000  # n-grams of the sets of one block
BLOCK_SETS = 256
LEADERS = 16  # sets whose overlaps a block keeps to derive others from
LOT = 2_000_000  # n-grams that a task counts or turns into postings at once
SKETCH_SETS = 4096  # sets whose bitmaps make up a block, and
SKETCH_BYTES = 8 << 20  # their bytes at most
BATCH_ROWS = 1000  # documents or sets that come to a task at once

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _need(size, share: int):
    """Least overlap of a set of this size with a partner: share percent of it, rounded up."""
    return (share * size + 99) // 100


def _extra(size):
    """Further n-grams that the counting filter asks for; never falls with the size."""
    return 1 + size // 8


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row from, row to, row of each n-gram, n-gram hashes): ascending and distinct within each row."""
    data, offsets = text_bytes(column)
    for low, high in pieces(offsets):
        words = Words(data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low], lower=True)
        hashes = words.hashes()
        at = inside(words.first, n)
        rows, grams = row_of(words.first)[at], windows(hashes, n)[at]
        short = np.flatnonzero((words.counts > 0) & (words.counts < n))
        if len(short):  # the whole sequence is the only n-gram; its length keeps it apart from others
            whole = [hashes[words.first[k]: words.first[k + 1]] for k in short]
            rows = np.concatenate([rows, short])
            grams = np.concatenate([grams, [windows(w, len(w))[0] ^ np.uint64(len(w)) for w in whole]]).astype(np.uint64)
        order = np.lexsort((grams, rows))
        rows, grams = rows[order], grams[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
        yield low, high, rows[new], grams[new]


def _digest(n: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for low, high, rows, grams in _sets(batch.column(1), n):
                edges = np.searchsorted(rows, np.arange(high - low + 1))
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum((grams ^ (grams >> np.uint64(31))) * m)]) for m in (_M1, _M2)]
                one, two = (s[edges[1:]] - s[edges[:-1]] for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), pa.array(np.diff(edges), pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    names=["_id", "n_shingles", "_d1", "_d2"],
                )

    return run


def _offer_sketch(n: int, share: int):
    def offer(batch):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for low, high, rows, grams in _sets(batch.column(1), n):
            edges = np.searchsorted(rows, np.arange(high - low + 1))
            sizes = np.diff(edges)
            place = np.arange(len(rows)) - edges[rows]
            chosen = place < (sizes - _need(sizes, share) + _extra(sizes))[rows]
            # rows that share an id differ in size or are alike enough to be judged together
            yield ids[low:high], sizes, rows[chosen], place[chosen], grams[chosen]

    return offer


def _surviving(share: int):
    """Sets with as many shared n-grams among their smallest ones as a partner of any size would give them."""

    def run(batches):
        for batch in batches:
            size = batch.column(1).to_numpy()
            least = _extra(_need(size, share))
            found = np.array([len(unpack_places(b.as_py())) for b in batch.column(2)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(found >= least))], names=["_node"])

    return run


def _parity(grams: np.ndarray) -> np.ndarray:
    """Bitmap whose bit counts how often n-grams fall on it, modulo 2: two bitmaps differ in no more bits than the sets in n-grams."""
    bits = np.bincount((grams >> np.uint64(20)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _sketch_bits(size: int) -> int:
    return max(64, 1 << (size - 1).bit_length())


def _sketch(grams: np.ndarray) -> bytes:
    """A parity bitmap with a bit or more for each n-gram."""
    width = _sketch_bits(len(grams))
    odd = np.bincount((grams >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (a row each) as they are with fewer words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _full_sets(n: int):
    def run(batches):
        for batch in batches:
            for low, high, rows, grams in _sets(batch.column(1), n):
                edges = np.searchsorted(rows, np.arange(high - low + 1))
                sets = [grams[a:b] for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low), pa.array(np.diff(edges), pa.int64()),
                        pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([_sketch(x) for x in sets], pa.binary()),
                    ],
                    names=["node", "size", "grams", "sketch"],
                )

    return run


def _lots(batches, column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the n-grams of a part stay under ``LOT``; a longer set is a part of its own."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch.column(column)).to_numpy()) // 8
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + LOT, "right")))
            yield batch.slice(low, high - low)
            low = high


def _frequent(least_share: float):
    """(gram, sets of this lot that have it) for those that a lot of sets finds in enough of them."""

    def run(batches):
        held: list[np.ndarray] = []
        n_held = 0

        def counted():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(2, least_share * len(held))
            return pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["gram", "n"])

        for batch in _lots(batches, 0):
            sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in batch.column(0)]
            more = sum(map(len, sets))
            if held and n_held + more > LOT:
                yield counted()
                held, n_held = [], 0
            held += sets
            n_held += more
        if held:
            yield counted()

    return run


def _postings(hot: np.ndarray, share: int):
    """Prefix n-grams of each set under the order (frequent last, then by hash)."""

    def run(batches):
        for batch in _lots(batches, 2):
            nodes, sizes = (batch.column(i).to_numpy() for i in range(2))
            kept = sizes - _need(sizes, share) + 1
            prefixes, parities = [], np.empty((len(nodes), PARITY), np.uint64)
            for k, blob in enumerate(batch.column(2)):
                grams = np.frombuffer(blob.as_buffer(), np.uint64)
                frequent = np.isin(grams, hot)
                prefixes.append(np.concatenate([grams[~frequent], grams[frequent]])[: kept[k]])
                parities[k] = _parity(grams)
            if prefixes:
                gram = np.concatenate(prefixes)
                first = np.cumsum(kept) - kept
                bits = pa.py_buffer(np.repeat(parities, kept, axis=0))
                offsets = pa.py_buffer(np.arange(len(gram) + 1, dtype=np.int32) * np.int32(8 * PARITY))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram.view(np.int64)), pa.array(np.repeat(sizes, kept)), pa.array(np.arange(len(gram)) - np.repeat(first, kept)),
                        pa.array(np.repeat(nodes, kept)), pa.Array.from_buffers(pa.binary(), len(gram), [None, offsets, bits]), pa.array(np.isin(gram, hot)),
                    ],
                    names=["gram", "size", "place", "node", "parity", "hot"],
                )

    return run


class _Labels:
    """Connected parts of a few sets; a forest of the links goes out."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: int, found: np.ndarray) -> list[int]:
        """Connect a with the sets found; returns one of each part that was apart before."""
        labels, first = np.unique(self.of[found], return_index=True)
        apart = labels != self.of[a]
        if not apart.any():
            return []
        self.of[np.isin(self.of, labels[apart])] = self.of[a]
        return found[first[apart]].tolist()


def _could_link(size_a, place_a, parity_a, sizes, places, parities, share: int) -> np.ndarray:
    """Which pairs (set a is no larger) can reach the overlap of a link, judged by size, position and parity."""
    need = -(-share * (size_a + sizes) // (100 + share))
    fits = share * sizes <= 100 * size_a
    # from these places on lies all that can be common, if this is the first common n-gram
    fits &= np.minimum(size_a - place_a, sizes - places) >= need
    at = np.flatnonzero(fits)
    if len(at):
        room = (size_a + sizes - 2 * need)[at]
        other = parity_a[at] if np.ndim(parity_a) > 1 else parity_a
        fits[at] = np.bitwise_count(parities[at] ^ other).sum(axis=1) <= room
    return fits


def _short_lists(start, end, sizes, places, nodes, parities, share: int) -> Iterator[np.ndarray]:
    """Candidate pairs of many short index lists, by distance in the list."""
    for distance in range(1, SHORT_LIST):
        long_enough = end - start > distance
        if not long_enough.any():
            return
        a = ranges(start[long_enough], end[long_enough] - distance)
        b = a + distance
        fits = _could_link(sizes[a], places[a], parities[a], sizes[b], places[b], parities[b], share)
        yield np.stack([nodes[a[fits]], nodes[b[fits]]], axis=1)


def _list_forest(sizes, places, nodes, parities, share: int) -> list[tuple[int, int]]:
    """Edges that connect the candidates of one index list, which is ordered by size and place.

    The walk ends at the first block whose sets are all too large; blocks whose least place is too far back
    are skipped.  Sets already connected are not connected again.
    """
    n = len(sizes)
    labels, out = _Labels(n), []
    nearest = [int(places[b: b + LIST_BLOCK].min()) for b in range(0, n, LIST_BLOCK)]
    for a in range(n - 1):
        for block in range((a + 1) // LIST_BLOCK, len(nearest)):
            low, high = max(block * LIST_BLOCK, a + 1), min((block + 1) * LIST_BLOCK, n)
            if share * sizes[low] > 100 * sizes[a]:
                break
            least_need = -(-share * (sizes[a] + sizes[low]) // (100 + share))
            if sizes[a] - places[a] < least_need or sizes[high - 1] - nearest[block] < least_need:
                continue
            open_ = low + np.flatnonzero(labels.of[low:high] != labels.of[a])
            if len(open_):
                fits = _could_link(sizes[a], places[a], parities[a], sizes[open_], places[open_], parities[open_], share)
                out += [(int(nodes[a]), int(nodes[k])) for k in labels.join(a, open_[fits])]
    return out


def _lists(share: int):
    """Postings come sorted by (gram, size, place, node)."""

    def run(batches):
        held: list = []
        left: list[np.ndarray] = []

        def close():
            gram, size, place, node = (np.concatenate([h[i] for h in held]) for i in range(4))
            parity = np.concatenate([h[4] for h in held])
            cut = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            ends = np.append(cut[1:], len(gram))
            short = ends - cut <= SHORT_LIST
            left.extend(_short_lists(cut[short], ends[short], size, place, node, parity, share))
            for a, b in zip(cut[~short], ends[~short]):
                left.append(np.array(_list_forest(size[a:b], place[a:b], node[a:b], parity[a:b], share), np.int64).reshape(-1, 2))

        def edges():
            pairs = np.unique(np.sort(np.concatenate(left), axis=1), axis=0)
            left.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            gram, size, place, node = (batch.column(i).to_numpy() for i in range(4))
            parity = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, PARITY)
            # all lists but the last of a batch are complete
            last = int(np.searchsorted(gram, gram[-1])) if gram[0] != gram[-1] else 0
            if last or (held and held[-1][0][-1] != gram[0]):
                head = [x[:last] for x in (gram, size, place, node, parity)]
                held.append(head)
                close()
                held.clear()
            held.append([x[last:] for x in (gram, size, place, node, parity)])
            if sum(map(len, left)) > 200_000:
                yield edges()
        if held:
            close()
        if left:
            yield edges()

    return run


def _block_links(nodes, sets: list[np.ndarray], side: np.ndarray, share: int) -> Iterator[tuple[int, int]]:
    """Forest of true links among the sets of a block; only between sides if there are two.

    Overlaps of one set with the whole block come from the block's index lists.  If an earlier set with kept
    overlaps is close, they are corrected by the lists of the n-grams that only one of the two has.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    # a block is one of the largest things a task holds, so n-grams are numbered in 32 bits and sorted once
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    posting = np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
    grams = grams[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    del grams
    begin = np.append(np.flatnonzero(new), len(new)).astype(np.int32)
    number = np.empty(len(new), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    del order, new
    ids = [np.sort(number[edges[k]: edges[k + 1]]) for k in range(n)]
    del number
    two = side.min() != side.max()
    labels = _Labels(n)
    leaders: list[tuple[int, np.ndarray]] = []

    def count(these: np.ndarray) -> np.ndarray:
        low, high = begin[these].astype(np.int64), begin[these + 1].astype(np.int64)
        return np.bincount(posting[ranges(low, high)], minlength=n)

    for k in range(n):
        apart, leader = sizes[k], None
        for which, (j, overlap) in enumerate(leaders):
            differ = sizes[k] + sizes[j] - 2 * overlap[k]
            if differ < apart:
                apart, leader = differ, which
        if leader is not None and 2 * apart <= sizes[k]:
            j, overlap = leaders[leader]
            overlap = overlap + count(np.setdiff1d(ids[k], ids[j], assume_unique=True)) - count(np.setdiff1d(ids[j], ids[k], assume_unique=True))
        else:
            overlap = count(ids[k])
            leaders.append((k, overlap))
            del leaders[:-LEADERS]
        linked = 100 * overlap >= share * (sizes[k] + sizes - overlap)
        linked[: k + 1] = False
        if two:
            linked &= side != side[k]
        for m in labels.join(k, np.flatnonzero(linked)):
            yield int(nodes[k]), int(nodes[m])


def _sketch_links(nodes, sizes: np.ndarray, sketches: list[bytes], side: np.ndarray, share: int) -> Iterator[tuple[int, int]]:
    """Forest of the pairs among sets ordered by size whose bitmaps leave room for a link; only between sides if there are two.

    Bitmaps differ in no more bits than the sets in n-grams, so no link is missed.
    """
    two = side.min() != side.max()
    labels = _Labels(len(sizes))
    widths = np.array([len(x) for x in sketches]) // 8
    for words in np.unique(widths):
        first, after = np.searchsorted(widths, words), np.searchsorted(widths, words, "right")
        # the partners of these sets, none of them smaller, have bitmaps as wide or wider
        last = int(np.searchsorted(share * sizes, 100 * sizes[after - 1], "right"))
        held = np.concatenate([_folded(np.frombuffer(x, np.uint64)[None, :], words) for x in sketches[first:last]])
        for a in range(first, after):
            end = int(np.searchsorted(share * sizes, 100 * sizes[a], "right"))
            for low in range(a + 1, end, LIST_BLOCK):
                part = slice(low, min(low + LIST_BLOCK, end))
                open_ = labels.of[part] != labels.of[a]
                if two:
                    open_ &= side[part] != side[a]
                at = low + np.flatnonzero(open_)
                if len(at):
                    room = sizes[a] + sizes[at] - 2 * -(-share * (sizes[a] + sizes[at]) // (100 + share))
                    fits = np.bitwise_count(held[at - first] ^ held[a - first]).sum(axis=1, dtype=np.int64) <= room
                    for m in labels.join(a, at[fits]):
                        yield int(nodes[a]), int(nodes[m])


def _sketch_blocks(share: int):
    """Like ``_blocks``, of bitmaps."""

    def forest(held):
        held.sort(key=lambda h: (h[1], h[0]))
        nodes, sizes, sketches, side = zip(*held)
        return _sketch_links(nodes, np.array(sizes), sketches, np.array(side), share)

    return _pairs_of_blocks(forest, lambda mine, node, size, sketch: (node, size, sketch, mine))


def _blocks(share: int):
    """Rows come sorted by (root, i, j): the sets of one pair of blocks of a cluster after the other."""

    def forest(held):
        held.sort(key=lambda h: (len(h[1]), h[0]))
        return _block_links([h[0] for h in held], [np.frombuffer(h[1], np.uint64) for h in held], np.array([h[2] for h in held]), share)

    return _pairs_of_blocks(forest, lambda mine, node, grams: (node, grams, mine))


def _pairs_of_blocks(forest, of):
    """``forest`` of what ``of`` makes of the rows, after root, i and j, of one pair of blocks."""

    def run(batches):
        key, held = None, []

        def close():
            if len(held) < 2:
                return None
            pairs = np.array(list(forest(held)), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"]) if len(pairs) else None

        for batch in batches:
            for root, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, i, j) != key:
                    links = close()
                    if links is not None:
                        yield links
                    key, held = (root, i, j), []
                held.append(of(*row))
        links = close()
        if links is not None:
            yield links

    return run


def _grid(sets: DataFrame, blocks: DataFrame, total: int, parts: int) -> DataFrame:
    """Rows of ``sets`` (root, node, ...) dealt to every pair of blocks (i, j) of their cluster: root, i, j, mine, node, ..."""
    held = [c for c in sets.columns if c not in ("root", "node")]
    placed = join_unique(sets, blocks, "root", total).withColumn("_mine", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    grid = placed.select("root", "node", *held, "_mine", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_with"))
    grid = grid.select("root", F.least("_mine", "_with").alias("i"), F.greatest("_mine", "_with").alias("j"), F.col("_mine").alias("mine"), "node", *held)
    return grid.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")


def _cut(sets: DataFrame, weight, most_sets: int, most: int) -> DataFrame:
    """root, _blocks: into how many blocks the clusters of more than one set are cut, of so many sets and so much weight each."""
    sized = sets.groupBy("root").agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_t")).where("_n > 1")
    return sized.select("root", F.greatest(F.ceil(F.col("_n") / most_sets), F.ceil(F.col("_t") / most)).cast("int").alias("_blocks"))


def _parted(full: DataFrame, clusters: DataFrame, blocks: DataFrame, total: int, share: int) -> DataFrame:
    """``clusters`` with those of more than one block cut to the sets that their bitmaps still connect."""
    parts = shuffle_partitions(full.sparkSession)
    large = blocks.where("_blocks > 1").select("root")
    sketches = materialise(full.select("node", "size", "sketch").join(clusters.join(large, "root", "left_semi"), "node"), "sketches").select("root", "node", "size", "sketch")
    cut = materialise(_cut(sketches, F.length("sketch"), max(SKETCH_SETS, 2 * total // parts), SKETCH_BYTES), "sketch-blocks")
    near = materialise(_grid(sketches, cut, total, parts).mapInArrow(gives_back(_sketch_blocks(share)), "a long, b long"), "sketch-edges")
    # a root is a set of its cluster, so no other cluster has it
    return clusters.join(large, "root", "left_anti").select("node", "root").unionByName(components(near))


def near_copies(docs: DataFrame, n: int = 4, share: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id).

    The set of a document holds its distinct sequences of ``n`` lower-cased (A-Z) words, or its whole
    sequence if it has fewer words.  Two documents link if 100 * |common| >= share * |union|; component_id
    is the smallest id that links reach, the document's own included.

    NULL and empty texts have an empty set and link with nothing (component_id is their own id).  A row
    without id links nothing; its component_id is that of the documents with the same set, NULL if there are
    none.  Rows that share an id are one node of the graph.  Other columns are ignored.

    No n-gram list or group is gathered whole: equal sets are one, an n-gram that more than one set of a
    thousand has is ordered last and connects its sets through a node of its own, and clusters are cut into
    blocks of bounded size whose pairs go to different tasks.  N-grams are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    # all that runs in Python ends inside: what is returned reads written tables only
    with disposable(spark) as keep, small_batches(spark, BATCH_ROWS):
        sets = materialise(rows.mapInArrow(gives_back(_digest(n)), "_id long, n_shingles long, _d1 long, _d2 long"), "sets")
        held = sets.where("n_shingles > 0 AND _id IS NOT NULL")
        nodes = held.groupBy("_d1", "_d2", "n_shingles").agg(F.min("_id").alias("_node"))
        nodes = materialise(nodes, "nodes")

        rows = rows.where("_id IS NOT NULL")
        seen = found_elsewhere(rows, _offer_sketch(n, share), earlier=False, exact=False)
        alive = seen.select("doc_id", "tag", "places").mapInArrow(gives_back(_surviving(share)), "_node long").distinct()
        alive = materialise(nodes.select("_node").distinct().join(alive, "_node", "left_semi"), "alive")
        chosen = rows.join(alive, rows["_id"] == alive["_node"], "left_semi")
        full = materialise(chosen.mapInArrow(gives_back(_full_sets(n)), "node long, size long, grams binary, sketch binary"), "full-sets")

        total = max(1, full.count())
        often = full.select("grams").mapInArrow(gives_back(_frequent(1 / HOT_SHARE)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        hot = np.array([r["gram"] for r in often.where(F.col("n") > max(8, total // HOT_SHARE)).select("gram").collect()], np.int64).view(np.uint64)
        postings = full.select("node", "size", "grams").mapInArrow(gives_back(_postings(hot, share)), "gram long, size long, place long, node long, parity binary, hot boolean")
        parts = shuffle_partitions(spark)
        lists = postings.where("NOT hot").drop("hot").repartition(parts, "gram").sortWithinPartitions("gram", "size", "place", "node")
        near = materialise(lists.mapInArrow(gives_back(_lists(share)), "a long, b long"), "list-edges")
        # sets meet at the node of a frequent n-gram and their class of size; a partner is in this class or the next
        step = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100 / share)))
        knots = postings.where("hot").select(
            F.col("node").alias("a"), F.explode(F.array(step, step + 1)).alias("_class"), "gram"
        ).select("a", (-F.pmod(F.xxhash64("gram", "_class"), F.lit((1 << 62) - 1)) - 2).alias("b"))
        knots = materialise(knots.distinct(), "knots")
        clusters = materialise(components(near.unionByName(knots)).select(F.col("node"), F.col("root")), "clusters")

        limit = max(BLOCK_SETS, 2 * total // parts)

        def cut(clusters):
            sizes = full.select("node", "size").join(clusters, "node")
            return materialise(_cut(sizes, F.col("size"), limit, BLOCK_TOKENS), "cluster-blocks")

        blocks = cut(clusters)
        if not blocks.where("_blocks > 1").isEmpty():
            clusters = materialise(_parted(full, clusters, blocks, total, share), "parted-clusters")
            blocks = cut(clusters)
        inside_ = full.select("node", "grams").join(clusters, "node").select("root", "node", "grams")
        grid = _grid(inside_, blocks, total, parts)
        links = materialise(grid.mapInArrow(gives_back(_blocks(share)), "a long, b long"), "links")

        # equal sets: every other id of the set reaches its smallest one, so their own nodes need no edge
        joined = components(links).groupBy("node").agg(F.min("root").alias("root"))
        named = nodes.join(joined, nodes["_node"] == joined["node"], "left").select("_d1", "_d2", "n_shingles", F.coalesce("root", "_node").alias("component_id"))
        named = keep(materialise(named.select(F.xxhash64("_d1", "_d2", "n_shingles").alias("_key"), "component_id").groupBy("_key").agg(F.min("component_id").alias("component_id")), "components"))
        keyed = keep(materialise(sets.select("_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.xxhash64("_d1", "_d2", "n_shingles")).alias("_key")), "keyed"))
    linked = join_unique(keyed.where("_key IS NOT NULL"), named, "_key", keyed.count())
    lone = keyed.join(named.select(F.col("_key").alias("_k")), F.col("_key") == F.col("_k"), "left_anti")
    return linked.select(F.col("_id").alias(id_col), "n_shingles", "component_id").unionByName(
        lone.select(F.col("_id").alias(id_col), "n_shingles", F.col("_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, n: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns: of each component only the document with the smallest id.

    Of rows with one id and equal text, one stays: the one whose columns come first as JSON.  Rows without id
    take part like the others, every distinct text as a document that comes after all with ids, so one
    stays only if its component has no id.
    """
    text = F.col(text_col)
    key = F.md5(F.concat_ws("\u0001", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.when(text.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), text))).cast("binary"))
    # the row travels as one struct, so that its names cannot meet those used here
    rows = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"), F.col(id_col).cast("long").alias("_id"), text.alias("_text"))
    with disposable(docs.sparkSession) as keep:
        keys = materialise(rows.groupBy("_key", "_id").agg(F.count(F.lit(1)).alias("_n")), "keys")
        named, total = keys.where("_id IS NOT NULL").withColumn("_bare", F.lit(False)), None
        texts = rows.where("_id IS NOT NULL").select("_id", "_text")
        bare = keys.where("_id IS NULL").select("_key", "_n")
        if not bare.isEmpty():
            low, high, total = keys.agg(F.min("_id"), F.max("_id"), F.sum("_n")).first()
            bare, n_bare = number_rows(bare, ["_key"], pos="_id")
            # numbers that no id has, above all or below all; which document leads is settled by _bare
            first = 0 if high is None else high + 1 if high < (1 << 63) - 1 - n_bare else low - n_bare
            if first < -(1 << 63):
                raise ValueError("ids from the least to the greatest long leave no numbers for rows without id")
            bare = materialise(bare.select("_key", (F.col("_id") + first).alias("_id"), "_n", F.lit(True).alias("_bare")), "bare")
            texts = texts.unionByName(join_unique(rows.where("_id IS NULL").select("_key", "_text"), bare.select("_key", "_id"), "_key", total).select("_id", "_text"))
            named = named.unionByName(bare)
        found = near_copies(texts, n, share, "_id", "_text")
        if total is None:
            leaders = found.where(F.col("component_id") == F.col("_id")).select("_id").distinct()
        else:
            marked = found.select("_id", "component_id").distinct().join(named.select("_id", "_bare").distinct(), "_id")
            leaders = marked.groupBy("component_id").agg(F.min(F.struct("_bare", "_id")).alias("_first")).select("_first._id")
        leaders = materialise(leaders, "leaders")
        kept = keep(materialise(named.join(leaders, "_id", "left_semi").select("_key", "_n"), "kept"))
    once = rows.join(kept.where("_n = 1"), "_key", "left_semi").select("_row.*")
    again = kept.where("_n > 1").select("_key")
    if again.isEmpty():
        return once
    several = join_unique(rows.select("_key", "_row"), again, "_key", rows.count())
    chosen = several.groupBy("_key").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return once.unionByName(chosen.select("_row.*"))
