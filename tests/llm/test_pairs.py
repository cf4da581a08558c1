"""Jaccard join, passage removal and decontamination against brute force."""

import hashlib
import itertools
import random
import time
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.texts import LONG, ODD, frame, lower, near_texts, rows_of, words
from tidemark.llm import jaccard_join
from tidemark.llm.decontaminate import MASKS, SHARE, SPAN, WINDOW, decontaminate, find_leaks, masks_of
from tidemark.llm.jaccard_join import keep_one, near_copies
from tidemark.llm.substring_dedup import COVER, PERIOD, passage_digest
from tidemark.session import materialise


def components(rows, n, share):
    sets = defaultdict(set)
    for i, t in rows:
        w = words(lower(t))
        grams = [tuple(w[k: k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else []
        sets[i].add(frozenset(grams))
    up = {i: i for i in sets if i is not None}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(up)
    for p, a in enumerate(ids):
        for b in ids[:p]:
            for x in sets[a]:
                for y in sets[b]:
                    both = len(x & y)
                    if x and y and 100 * both >= share * (len(x) + len(y) - both):
                        a_, b_ = root(a), root(b)
                        up[max(a_, b_)] = min(a_, b_)
    return {i: (v, root(i) if i is not None else None) for i, v in sets.items()}


@pytest.mark.parametrize("n,share", [(4, 85), (5, 80)])
def test_components(spark, n, share):
    rows = near_texts(n) + ODD + [(910, LONG + " more"), (911, "one")]
    got = near_copies(frame(spark, rows), n, share)
    want = components(rows, n, share)
    expected = sorted(((i, len(s), want[i][1]) for i, t in rows for s in _set(t, n)), key=repr)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == expected
    kept = rows_of(keep_one(frame(spark, rows), n, share), "doc_id")
    leaders = {v[1] for i, v in want.items() if i is not None}
    assert {i for (i,) in kept} == leaders | {None}
    assert near_copies(frame(spark, rows[:0]), n, share).count() == 0


@pytest.mark.parametrize("top", [1000, (1 << 63) - 1])
def test_keep_one_drops_repeats_and_rows_without_id(spark, top):
    text = " ".join(f"k{i}" for i in range(60))
    near, other = text.replace("k59", "new"), " ".join(f"o{i}" for i in range(60))
    rows = ODD + [(7, text), (7, text), (8, near), (None, text), (None, near), (None, other), (None, other), (None, other + " more")]
    rows += [(5, "one text"), (5, "second"), (5, "one text"), (top, None), (top, None), (None, None), (None, None)]
    kept = rows_of(keep_one(frame(spark, rows), 5, 80), "doc_id", "text")
    left = {k for k in rows if k not in ((8, near), (None, text), (None, near), (None, other), (None, other + " more"))}
    bare = [t for i, t in kept if i is None and t is not None and t.startswith("o0")]
    assert len(bare) == 1 and bare[0] in (other, other + " more")
    assert kept == sorted([*left, (None, bare[0])], key=repr)


def _set(text, n):
    w = words(lower(text))
    yield {tuple(w[k: k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_sketches_miss_no_link():
    """Bitmaps connect what links connect, fold to any width, and part sets that share half."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    sets = [np.sort(base[k: k + size]) for k, size in ((0, 1000), (20, 1000), (40, 1030), (500, 1000), (520, 1020), (2000, 2040), (2010, 2060), (2100, 2300), (4500, 9), (4500, 8))]
    sets.sort(key=len)
    sizes = np.array([len(x) for x in sets])
    for side in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
        found = list(jaccard_join._sketch_links(np.arange(len(sets)), sizes, [jaccard_join._sketch(x) for x in sets], side, 85))
        both = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
        links = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * both[a][b] >= 85 * (sizes[a] + sizes[b] - both[a][b]) and (not side.any() or side[a] != side[b])]
        groups = lambda pairs: _groups(len(sets), pairs)
        assert links and all(groups(found)[a] == groups(found)[b] for a, b in links)
        assert all(both[a][b] > 0.7 * sizes[a] for a, b in found)


def _groups(n, pairs):
    of = list(range(n))
    for a, b in pairs:
        of = [of[a] if k == of[b] else k for k in of]
    return of


def test_chains_of_long_sets_are_cut(spark, monkeypatch):
    """Long texts that share halves with the next are one candidate cluster; only what links is dealt to blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 10_000)
    monkeypatch.setattr(jaccard_join, "SKETCH_SETS", 16)
    parts = [" ".join(f"w{k}x{i}" for i in range(900)) for k in range(31)]
    rows = [(k, f"{parts[k]} {parts[k + 1]}") for k in range(30)] + [(100 + k, f"{parts[k]} {parts[k + 1]} more {k}") for k in (3, 17)]
    cut, written = [], jaccard_join.materialise

    def watched(df, label):
        out = written(df, label)
        if label == "cluster-blocks":
            cut.append(sorted((r["_blocks"] for r in out.collect()), reverse=True))
        return out

    monkeypatch.setattr(jaccard_join, "materialise", watched)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(frame(spark, rows)).collect()}
    assert got == {i: i - 100 if i >= 100 else i for i, _ in rows}
    assert cut[0][0] > 1 and cut[-1] == [1, 1]


def test_shuffles_go_with_the_write(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def held():
        return {x.split("/")[-1] for x in files.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}

    before = held()
    materialise(spark.range(5000).selectExpr("id % 97 AS k", "id").repartition(3, "k"), "dealt")
    until = time.time() + 20
    while (left := held() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left


def test_small_blocks_and_frequent_grams(spark, monkeypatch):
    """Many blocks, long lists, and every shared n-gram ordered last: the same components."""
    for name, value in (("BLOCK_SETS", 5), ("BLOCK_TOKENS", 400), ("LIST_BLOCK", 4), ("SHORT_LIST", 2), ("HOT_SHARE", 1_000_000), ("LEADERS", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_texts(9, 400)
    want = components(rows, 4, 85)
    got = near_copies(frame(spark, rows), 4, 85)
    assert rows_of(got, "doc_id", "component_id") == sorted(((i, v[1]) for i, v in want.items()), key=repr)


def test_derived_overlaps_equal_counted_ones():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = []
    for _ in range(120):
        s = base.copy()
        s[rng.integers(0, 200, rng.integers(0, 25))] = rng.integers(0, 1 << 60)
        sets.append(np.unique(s))
    sets.sort(key=len)
    links = list(jaccard_join._block_links(list(range(120)), sets, np.zeros(120, int), 85))
    up = list(range(120))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(120):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                up[max(root(a), root(b))] = min(root(a), root(b))
    want = [root(i) for i in range(120)]
    up = list(range(120))
    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert [root(i) for i in range(120)] == want


def passages(rows, window=13):
    first = {}
    order = {i: i if i is not None else 1 << 63 for i, _ in rows}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k: k + window])
            first[key] = min(first.get(key, 1 << 64), order[i])
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k: k + window])] < order[i]:
                gone[k: k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_passages(spark):
    shared = " ".join(f"p{i}" for i in range(60))
    rows = near_texts(2, 120) + ODD + [
        (700 + i, " ".join(f"u{i}w{j}" for j in range(i)) + " " + shared + f" tail{i}") for i in range(20)
    ] + [(None, shared), (800, " ".join(f"p{i}" for i in range(13))), (801, " ".join(f"p{i}" for i in range(12))), (802, "a b " * 40), (910, LONG)]
    assert rows_of(passage_digest(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == passages(rows)
    assert passage_digest(frame(spark, rows[:0])).count() == 0


def leaks(docs, items):
    seeds = defaultdict(set)
    tokens = {}
    for number, (item, t) in enumerate(items):
        w = words((t or "").lower())
        tokens[number] = (item, w)
        for p in range(len(w) - SPAN + 1):
            for k, mask in enumerate(MASKS):
                seeds[k, tuple(w[p + i] for i, c in enumerate(mask) if c == "1")].add((number, p))
    out = {}
    for i, t in docs:
        w = words((t or "").lower())
        for p in range(len(w) - SPAN + 1):
            for k, mask in enumerate(MASKS):
                for number, at in seeds[k, tuple(w[p + i] for i, c in enumerate(mask) if c == "1")]:
                    item, iw = tokens[number]
                    equal = [0 <= p - at + j < len(w) and w[p - at + j] == x for j, x in enumerate(iw)]
                    size = min(len(iw), WINDOW)
                    around = range(max(0, at + SPAN - size), min(at, len(iw) - size) + 1)
                    best = max(sum(equal[j: j + size]) for j in around)
                    if best >= SHARE * size:
                        out[i, item] = max(out.get((i, item), 0), best)
    return out


def test_leaks(spark):
    items = [(i, " ".join(f"q{i}_{j % 11 if i == 3 else j}" for j in range(10 + 7 * i))) for i in range(6)]
    items += [(3, "another text under the same id that is long enough to count"), (7, None), (8, ""), (9, "too short for a seed"), (None, " ".join(f"z{j}" for j in range(20)))]

    def altered(text, every):
        return " ".join("new" if k % every == every - 1 else w for k, w in enumerate(text.split()))

    docs = ODD + [(i, "before that " + items[i][1].upper() + " and after") for i in range(6)]
    docs += [(20 + i, "x " + altered(items[i][1], 7)) for i in range(6)] + [(30 + i, altered(items[i][1], 3)) for i in range(6)]
    docs += [(40, " ".join(items[5][1].split()[:18])), (41, " ".join(items[5][1].split()[-9:])), (42, items[10][1]), (None, items[4][1]), (43, items[6][1])]
    docs += [(20, "x " + altered(items[0][1], 7))] + near_texts(4, 50)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = leaks(docs, items)
    got = find_leaks(frame(spark, docs), benchmark)
    assert sorted({(r.doc_id, r.item_id, r.matched) for r in got.collect()}, key=repr) == sorted(((a, b, m) for (a, b), m in want.items()), key=repr)
    assert {(20 + i, i) for i in (1, 2, 3, 4, 5)} <= set(want) and not any(a is not None and 30 <= a < 36 for a, _ in want)
    clean = decontaminate(frame(spark, docs), benchmark)
    gone = {(a, t) for a, t in docs if any((a, b) in want for b in [x for x, _ in items]) and leaks([(a, t)], items)}
    assert rows_of(clean, "doc_id", "text") == sorted(((a, t) for a, t in docs if (a, t) not in gone), key=repr)
    assert clean.columns == frame(spark, docs).columns
    assert decontaminate(frame(spark, docs), benchmark.limit(0)).count() == len(docs)
    assert find_leaks(frame(spark, docs[:0]), benchmark).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    from tidemark.llm import decontaminate as module

    items = [(i, " ".join(f"q{i}_{j}" for j in range(30))) for i in range(5)]
    docs = [(i, "some words " + items[i][1]) for i in range(5)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(module, "BLOCK", 40)
    assert rows_of(find_leaks(frame(spark, docs), benchmark), "doc_id", "item_id") == [(i, i) for i in range(5)]


def test_every_replaced_pattern_has_a_seed():
    for size in range(1, WINDOW + 1):
        most = max(k for k in range(size + 1) if size - k >= SHARE * size)
        masks = [[i for i, c in enumerate(m) if c == "1"] for m in masks_of(size)]
        for gone in itertools.combinations(range(size), most):
            assert any(not {p + i for i in m} & set(gone) for m in masks for p in range(size - m[-1])), (size, gone)


def exhaustive_leaks(docs, items):
    """Every item laid over every place of every document, no seeds."""
    out = {}
    for i, t in docs:
        w = words((t or "").lower())
        for item, text in items:
            iw = words((text or "").lower())
            size = min(len(iw), WINDOW)
            for start in range(-len(iw), len(w)) if iw else ():
                equal = [0 <= start + j < len(w) and w[start + j] == x for j, x in enumerate(iw)]
                best = max(sum(equal[a: a + size]) for a in range(len(iw) - size + 1))
                if best >= SHARE * size:
                    out[i, item] = max(out.get((i, item), 0), best)
    return out


def test_leaks_by_exhaustive_alignment(spark):
    rng = random.Random(11)
    items = [(n, " ".join(f"q{n}_{j}" for j in range(n))) for n in range(1, 25)]
    docs = []
    for n, text in items:
        for k in range(n // 4 + 2):
            for _ in range(4):
                w = text.split()
                for j in rng.sample(range(n), min(k, n)):
                    w[j] = "new"
                docs.append((len(docs), " ".join(rng.choice([[], ["x", "y"]]) + w[rng.choice([0, 0, 1]):] + rng.choice([[], ["z"]]))))
    want = exhaustive_leaks(docs, items)
    got = find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.matched) for r in got.collect()) == sorted((a, b, m) for (a, b), m in want.items())
    assert set(range(1, 25)) == {b for _, b in want}


def test_memory_of_a_block():
    """A pair of full blocks takes little more than its n-grams; before, 63 bytes an n-gram."""
    import tracemalloc

    import numpy as np

    from tidemark.llm.jaccard_join import _block_links

    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 63, 100).astype(np.uint64)])) for _ in range(100)]
    tracemalloc.start()
    links = list(_block_links(np.arange(100), sets, np.arange(100) % 2, 80))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == 99 and peak < 40 * sum(map(len, sets))


def test_lots_of_postings_and_small_batches(spark, monkeypatch):
    """Postings and counts do not depend on how many sets come at once, and no more than a lot is worked on."""
    import numpy as np
    import pyarrow as pa

    from tidemark.llm import jaccard_join
    from tidemark.session import small_batches

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, size).astype(np.uint64)) for size in rng.integers(1, 40, 50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets])], names=["node", "size", "grams"])
    hot = np.array([3, 7], np.uint64)

    def postings():
        out = pa.Table.from_batches(jaccard_join._postings(hot, 80)([batch])).to_pylist()
        return sorted((r["node"], r["place"], r["gram"], r["size"], r["parity"], r["hot"]) for r in out)

    whole = postings()
    monkeypatch.setattr(jaccard_join, "LOT", 64)
    assert postings() == whole
    lots = list(jaccard_join._lots([batch], 2))
    assert len(lots) > 5 and sum(b.num_rows for b in lots) == 50
    for node, grams in enumerate(sets):
        ordered = [*(g for g in grams if g not in hot), *(g for g in grams if g in hot)][: len(grams) - -(-80 * len(grams) // 100) + 1]
        assert [(r[2], r[3], r[4], r[5]) for r in whole if r[0] == node] == [(int(g), len(grams), jaccard_join._parity(grams).tobytes(), bool(g in hot)) for g in ordered]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with small_batches(spark, 7):
        sizes = spark.range(0, 100, 1, 1).mapInArrow(lambda b: (pa.RecordBatch.from_arrays([pa.array([x.num_rows])], names=["n"]) for x in b), "n long").collect()
    assert max(r.n for r in sizes) == 7 and spark.conf.get(name) == before
