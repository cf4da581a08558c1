"""Encoding by rank trees: ids and decoded texts of the library itself, whatever the text holds."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.texts import ODD, frame, near_texts, rows_of
from tidemark.llm import rank_tree
from tidemark.llm.rank_tree import Merges, TreeEncoder, coded_digest, decode, encode, merge_many, merge_one

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(11)

    def char():
        return chr(rng.choice([rng.randrange(32, 127), rng.randrange(1, 0x300), rng.randrange(0x300, 0xD800), rng.randrange(0xE000, 0x20000), 32, 10]))

    texts = ["".join(char() for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += [f"a{chr(c)}B {chr(c)}{chr(c)} 1{chr(c)}!" for c in range(1, 0x400)]
    return texts + [
        "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|", "don't I'LL we've ' 's", "İstanbul ΑΣ ΑΣ. ß ẞ é 한글 日本語 ½² x y",
        "x" * 5000, "ab" * 3000, "".join(rng.choice("abcdefghij") for _ in range(40_000)), "word " * 200_000,
    ]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(encoder, texts):
    return [part.tolist() for ids, counts in encoder.encode(texts) for part in np.split(ids, np.cumsum(counts)[:-1])]


def test_ids_equal_the_library(library, monkeypatch):
    texts = odd_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(TreeEncoder(PATH), texts) == want
    monkeypatch.setattr(rank_tree, "WORDS", 50)  # the memory is emptied again and again
    monkeypatch.setattr(rank_tree, "PIECE", 64)
    assert ids_of(TreeEncoder(PATH), texts) == want
    assert ids_of(TreeEncoder(PATH), [None, "", "a"]) == [[], [], library.encode("a", add_special_tokens=False).ids]


def slowest(symbols, merges):
    """The definition: look for the leftmost pair of the lowest rank until there is none."""
    symbols = list(symbols)
    while True:
        ranks = [(merges.rank_of.get(a << 32 | b, 1 << 40), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))]
        if not ranks or min(ranks)[0] == 1 << 40:
            return symbols
        rank, k = min(ranks)
        symbols[k: k + 2] = [int(merges.made[rank])]


@pytest.mark.parametrize("length", [2, 3, 8, 9, 10, 33, 65])
def test_trees_equal_the_definition(length):
    merges, rng = Merges(PATH), np.random.default_rng(length)
    data = rng.choice(np.frombuffer(b"etaoinshr'", np.uint8), (60, length))
    symbols = merges.inner[data]
    symbols[:, -1] = merges.last[data[:, -1]]
    symbols[5:20, length // 2 + 1:] = -1
    got = merge_many(symbols, merges)
    for row, given in zip(got, symbols):
        want = slowest(given[given >= 0].tolist(), merges)
        assert row[row >= 0].tolist() == want == merge_one(given[given >= 0].tolist(), merges)


def test_digests(spark, library):
    rows = near_texts(4, 60) + ODD + [(2000 + k, t) for k, t in enumerate(odd_texts()[::40])]
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = coded_digest(frame(spark, rows), PATH)
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert coded_digest(frame(spark, rows[:0]), PATH).count() == 0
    back = decode(encode(frame(spark, rows), PATH), PATH).where("doc_id = 903").first()
    assert (back.token_ids, back.decoded) == (library.encode("one").ids, "one</w>")
    broken = spark.createDataFrame([(1, None), (2, [320, -5, 10_000_000, 49407])], "doc_id long, token_ids array<int>")
    assert rows_of(decode(broken, PATH), "doc_id", "decoded") == [(1, ""), (2, "a</w> <|endoftext|>")]
