"""Small tables with the awkward rows that every operator must take: NULLs, empty and long texts, repeated rows."""

import random
import re

LONG = " ".join(f"lang{i % 977} und{i % 13}" for i in range(40_000))
ODD = [
    (900, None), (901, ""), (902, " \n\t"), (903, "one"), (None, "text without an id that has some words in it"),
    (904, "same row"), (904, "same row"), (905, "first text of an id"), (905, "second text of the id"), (906, LONG),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


def near_texts(seed, n=300):
    """Copies of a few bases with words replaced, so that similarities lie on both sides of the limits."""
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(rng.choice([3, 5, 40, 120]))] for _ in range(10)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            text[rng.randrange(len(text))] = rng.choice("xyz") + str(rng.randrange(5))
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(text)))
    return rows


def frame(spark, rows, extra=True):
    """(doc_id, text) with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for c in ("_id", "_text", "_tag", "node", "root", "size", "value", "kind", "length", "n_tokens", "score", "_map", "ids", "piece"):
            df = df.selectExpr("*", f"'x' AS `{c}`")
    return df


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
