"""Divergence of sources against the definition, term by term and pair by pair."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.texts import rows_of
from tidemark.llm import divergence
from tidemark.llm.divergence import divergences


def want_of(rows, ranks=200):
    docs = [(lang or "", source or "", Counter("".join(c.lower() if c < "\x80" else c for c in w) for w in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in d[2])
        kept = [t for t, n in held.items() if n >= 3]
        groups = defaultdict(Counter)
        for _, source, terms in mine:
            groups[source].update(terms)
        whole = sum(groups.values(), Counter())

        def p_of(counts):
            size = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // size for t in kept}

        p, q = {s: p_of(c) for s, c in groups.items()}, p_of(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for source, counts in groups.items():
            pairs = [(sum(f(p[source][t], p[other][t]) for t in kept), other) for other in groups if other != source]
            terms = [(f(p[source][t], q[t]), t) for t in kept if counts[t] and p[source][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out, key=repr)


def odd_rows():
    rng = random.Random(13)
    rows = []
    words = ["Été", "éTÉ", "naïve", "x", "日本", "𝔘𝔫𝔦", "don't", "a1b2", "É", "the", "\x7fz", "ß"] + [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    for k in range(400):
        text = " ".join(rng.choice(words[: rng.choice([5, 20, 76])]) for _ in range(rng.choice([0, 1, 3, 30])))
        rows.append((rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "b", "c", "ü", None, "d" if k % 9 == 0 else "a"]), text))
    rows += [("en", "a", "the the same row again")] * 400  # half of all rows
    rows += [("de", "only", "ein ein Wort"), ("de", "only", "ein"), ("de", "only", "EIN"), ("it", "x", "poche parole"), ("it", "y", None), ("it", None, "")]
    rows += [("es", s, " ".join(f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(7) for b in range(7) for c in range(7)) + " " + s * 3) for s in "xyz"] + [("es", "x", "waaa")]
    return rows


@pytest.mark.parametrize("held", [300_000, 3])
def test_equals_the_definition(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rows = odd_rows()
    given = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    wide = given.selectExpr("*", "1 AS doc_id", "2 AS n", "'x' AS term", "3 AS value", "4 AS g", "5 AS size", "6 AS docs")
    got = rows_of(divergences(wide), "lang", "source", "part", "item", "value", "rank")
    assert got == want_of(rows)
    assert sum(r[2] == "term" and r[:2] == ("es", "y") for r in got) == 200  # equal values, cut in the order of terms
    assert rows_of(divergences(wide, ranks=3), "lang", "source", "part", "item", "value", "rank") == want_of(rows, 3)


def test_nothing(spark):
    none = spark.createDataFrame([], "lang string, source string, text string")
    assert divergences(none).count() == 0
    bare = spark.createDataFrame([("en", "a", "one"), ("en", "b", "two"), (None, None, None)], "lang string, source string, text string")
    assert rows_of(divergences(bare), "lang", "source", "part", "item", "value", "rank") == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
