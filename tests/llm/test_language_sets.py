"""Language filters against sets of n-grams kept in plain dictionaries, without false positives."""

from collections import Counter

import pytest

from tidemark.llm.language_id import held_out, learn, predict


def plain_grams(text):
    """Four bytes of lower-cased letters, inside a word or with one space at an end; other ASCII is space."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    line = b" " + b" ".join(raw.split()) + b" " if raw.split() else b""
    return [g for g in (line[k: k + 4] for k in range(len(line) - 3)) if b" " not in g[1:3]]


@pytest.fixture(scope="module")
def rows(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", held_out().alias("held")).collect()


def test_filters_agree_with_exact_sets(spark, sf, rows):
    counts = {}
    for r in rows:
        if not r.held and r.text is not None and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    counts = {lang: {g: n for g, n in c.items() if n > 1} for lang, c in counts.items()}
    shares = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    shares = {lang: {g: p for g, p in c.items() if p >= 1e-5} for lang, c in shares.items()}
    most = Counter()
    for c in shares.values():
        for g, p in c.items():
            most[g] = max(most[g], p)
    sets = {lang: {g for g, p in c.items() if p >= 0.25 * most[g]} for lang, c in shares.items()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = learn(docs.where(~held_out()))
    got = {r.doc_id: r for r in predict(docs, model).collect()}
    assert model.languages == sorted(sets)
    compared = 0
    for r in rows:
        grams = plain_grams(r.text or "")
        if len(grams) < 100:
            continue
        exact = {lang: sum(g in s for g in grams) / len(grams) for lang, s in sets.items()}
        ordered = sorted(exact, key=lambda lang: -exact[lang])
        mine = got[r.doc_id]
        assert abs(mine.score - exact[mine.lang_pred]) < 0.05
        if exact[ordered[0]] - exact[ordered[1]] > 0.1:
            assert mine.lang_pred == ordered[0]
            compared += 1
    assert compared > 100
