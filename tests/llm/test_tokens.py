"""Token lengths, packing and archives: exact sums, exact places, exact round trips."""

import hashlib
import os


import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.texts import ODD, frame, near_texts, rows_of
from tidemark.llm import warc
from tidemark.llm.bpe import BatchEncoder
from tidemark.llm.packing import pack, plan_bins, token_pieces
from tidemark.llm.token_lengths import context_limits, length_histogram, length_quantile, token_lengths
from tidemark.llm.warc import archived, make_archive, make_record, read_archive, read_archives, read_record, write_archives

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = near_texts(8, 60) + ODD + [
    (1000, "don't stop  two  spaces\n\nx \ttab"), (1001, "日本語 text ½ ² a1b2"), (1002, "<|endoftext|> É'é naïve"), (1003, "\nx\n y "),
    (1004, " lead"), (1005, "x" * 5000), (1006, "нет Ωmega ʼn ͸ z"),
    (1007, "a <|endoftext|> b"), (1008, "<|endoftext|><|endoftext|>"), (1009, "x  <|endoftext|>\n\n y<|endoftext"), (1010, "|>日本 <|endoftext|>  日本"), (1011, "<|endoftext|"), (1012, "|>"),
]


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(PATH)
    return [(i, e.ids) for (i, _), e in zip(ROWS, tokenizer.encode_batch([t or "" for _, t in ROWS], add_special_tokens=False))]


def test_ids_equal_the_tokenizer(reference):
    encoder = BatchEncoder(PATH)
    for _ in range(2):  # the second time from memory
        got = [ids[e[k]: e[k + 1]].tolist() for low, high, ids, e in encoder.encode(pa.array([t for _, t in ROWS])) for k in range(high - low)]
        assert got == [ids for _, ids in reference]


def test_context_limits(spark, reference):
    lengths = np.array([len(ids) for _, ids in reference])
    limits = context_limits(length_histogram(token_lengths(frame(spark, ROWS), PATH)))
    rows = limits.collect()
    assert sorted(r.context_limit for r in rows) == sorted(set(lengths.tolist()))
    for r in rows:
        c = r.context_limit
        assert (r.n_docs, r.docs_fitting, r.docs_longer) == ((lengths == c).sum(), (lengths <= c).sum(), (lengths > c).sum())
        assert (r.tokens_fitting, r.truncated_tokens) == (lengths[lengths <= c].sum(), np.minimum(lengths, c).sum())
    for q in (0.01, 0.5, 0.9, 1.0):
        assert length_quantile(limits, q).first().n_tokens == np.sort(lengths)[int(np.ceil(q * len(lengths))) - 1]
    assert context_limits(length_histogram(token_lengths(frame(spark, ROWS[:0]), PATH))).count() == 0
    by = token_lengths(frame(spark, ROWS), PATH).selectExpr("n_tokens", "IF(doc_id % 2 = 0, 'even', NULL) AS part")
    grouped = context_limits(length_histogram(by, ["part"]), ["part"]).collect()
    even = np.array([len(ids) for i, ids in reference if i is not None and i % 2 == 0])
    assert {r.context_limit: r.docs_fitting for r in grouped if r.part == "even"} == {c: (even <= c).sum() for c in even}
    assert sum(r.n_docs for r in grouped) == len(lengths)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing(spark, reference, capacity):
    pieces = token_pieces(frame(spark, ROWS), PATH, capacity)
    rows = pack(pieces, capacity).collect()
    by_doc = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= capacity and (r.piece == 0 or r.length == capacity)
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, ids))
    unique = {i: ids for i, ids in reference if i not in (904, 905)}
    for i, ids in unique.items():
        got = sorted(by_doc[i])
        assert sum((p[2] for p in got), []) == [*ids, 2]
        assert [p[1] for p in got] == np.cumsum([0, *(len(p[2]) for p in got[:-1])]).tolist()
    assert len(by_doc[904]) == len(by_doc[905]) == 2
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(s for _, s in held[:-1])]).tolist() and sum(s for _, s in held) <= capacity
    assert sorted(bins) == list(range(len(bins)))
    assert len(bins) <= 1.1 * sum(r.length for r in rows) / capacity + 2
    assert pack(token_pieces(frame(spark, ROWS[:0]), PATH), capacity).count() == 0


def test_best_two_fit():
    # 5 is left a gap of 5 by the greedy fill with 10; 8 and 7 fill the room of 5 and its gap exactly
    assert plan_bins({10: 1, 5: 1, 6: 1, 4: 1}, 20) == [([10, 6, 4], 1), ([5], 1)]
    assert plan_bins({60: 1, 30: 1, 20: 2}, 100) == [([60, 20, 20], 1), ([30], 1)]
    rng = np.random.default_rng(3)
    for _ in range(5):
        counts = {}
        for s in np.clip(rng.lognormal(5, 1, 20_000), 1, 1024).astype(int).tolist():
            counts[s] = counts.get(s, 0) + 1
        plan = plan_bins(counts, 1024)
        used = {}
        for held, times in plan:
            assert sum(held) <= 1024
            for s in held:
                used[s] = used.get(s, 0) + times
        assert used == counts
        assert sum(t for _, t in plan) <= -(-sum(s * n for s, n in counts.items()) // 1024) + 2


# ------------------------------------------------------------------ archives


def test_record_round_trip():
    raw = make_record(7, "http://a/b", "é\r\n\r\nx".encode(), None, False)
    assert read_record(raw) == (7, "http://a/b", "response", 7, hashlib.sha1("é\r\n\r\nx".encode()).hexdigest(), None, "é\r\n\r\nx".encode())
    raw = make_record(-8, None, b"q" * 1000, 9, True)
    assert read_record(raw) == (-8, None, "revisit", 1000, hashlib.sha1(b"q" * 1000).hexdigest(), 9, None)
    broken = bytearray(make_record(7, "u", b"payload", None, False))
    broken[-6] ^= 1
    with pytest.raises(ValueError):
        read_record(bytes(broken))


def test_archive_layout():
    records = [make_record(i, f"http://h/{i}", (f"<html><p>number {i}</p>" * 20).encode() + os.urandom(20), None, False) for i in range(200)]
    content = make_archive(records)
    assert content[:4] == warc.MAGIC.to_bytes(4, "little") and list(read_archive(content)) == records
    # the dictionary pays: the same records without it are larger
    import zstandard

    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(content) < plain
    assert list(read_archive(make_archive(records[:2]))) == records[:2]
    big = [make_record(1, None, os.urandom(300_000), None, False), records[0]]
    assert list(read_archive(make_archive(big))) == big
    with pytest.raises(ValueError):
        list(read_archive(content[:-3]))


def test_archives(spark, tmp_path):
    page = "x y z " * 400
    rows = [
        (1, "u", page), (2, "v", page), (2, "v", page), (None, "w", page), (3, None, None), (4, "a\nb", ""), (5, "c", "é" * 499), (6, "c", "é" * 499),
        (7, "c", "é" * 500), (-8, "c", "é" * 500), (9, "long", "<p>text</p>" * 100_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS refers_to", "1 AS _digest", "2 AS _d")
    leader = {page: 2, "é" * 500: 7}
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = leader.get(html) if i is not None and leader.get(html) != i else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to is not None else "response", to))
    got = archived(spark, pages)
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    folder = f"file://{tmp_path}/archives"
    listed = write_archives(pages, folder, archive_bytes=5_000)
    assert listed.count() == len(list((tmp_path / "archives").glob("*.warc.zst"))) > 1
    back = read_archives(spark, folder).where("record_type = 'response'")
    assert sorted(bytes(r.payload).decode() for r in back.collect() if r.page_id in (7, 9, 3)) == sorted(["é" * 500, rows[-1][2], ""])
    assert archived(spark, pages.limit(0)).count() == 0


