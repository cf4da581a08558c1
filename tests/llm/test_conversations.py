"""Repair of conversations against a search over all edits and a plain reading of the rules."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from tests.llm.texts import rows_of
from tidemark.llm import conversations
from tidemark.llm.conversations import ACCEPTED, NEW, chain, cheapest, damage, ranked, repair_digest, repaired, solve

GRAMMAR = re.compile("(s?(ua)+)?")


def slowest(symbols):
    """Every sequence of edits with up to three inserts in a gap: (cost, audit) of the cheapest, ties ASCII-least."""
    gaps = ["", "u", "a", "ua", "au", "uau", "aua"]
    found = []
    options = []
    for c in symbols:
        more = 5 * c.isupper()
        options.append([(2, "D", "")] + ([] if c == "D" else [(more, "K", c.lower()), (1 + more, "R", "u"), (1 + more, "R", "a")]))
    for edits in itertools.product(*options):
        for given in itertools.product(gaps, repeat=len(symbols) + 1):
            roles = given[0] + "".join(e[2] + g for e, g in zip(edits, given[1:]))
            if GRAMMAR.fullmatch(roles):
                audit = "I" * len(given[0]) + "".join(e[1] + "I" * len(g) for e, g in zip(edits, given[1:]))
                found.append((sum(e[0] for e in edits) + 5 * sum(map(len, given)), audit))
    return min(found)


def test_lattice_equals_all_edits():
    for n in range(4):
        for symbols in itertools.product("suaxSUAXD", repeat=n):
            if n < 3 or zlib.crc32("".join(symbols).encode()) % 12 == 0:
                assert cheapest("".join(symbols), NEW, ACCEPTED, True) == slowest(symbols), symbols


def in_order(symbols):
    """A plain walk backwards over all turns, for long conversations."""

    @functools.cache
    def rest(at, state):
        if at == len(symbols):
            return {0: (0, ""), 3: (0, ""), 1: (10, "II"), 2: (5, "I")}[state]
        c, more, ways = symbols[at], 5 * symbols[at].isupper(), []
        for inserts in range(3):
            now = state
            for _ in range(inserts):
                now = 3 if now == 2 else 2
            options = [(2, "D", now)]
            if c != "D":
                options.append((1 + more, "R", 3 if now == 2 else 2))
                kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(c.lower(), {}).get(now)
                options += [(more, "K", kept)] if kept is not None else []
            for cost, edit, to in options:
                then = rest(at + 1, to)
                ways.append((5 * inserts + cost + then[0], "I" * inserts + edit + then[1]))
        return min(ways)

    for at in range(len(symbols), 0, -50):
        rest(at, 0), rest(at, 1), rest(at, 2), rest(at, 3)
    return rest(0, 0)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_chain_of_blocks(size):
    rng = random.Random(size)
    for _ in range(40):
        symbols = "".join(rng.choice("sssuuuuaaaaxUUAAXSDD") for _ in range(rng.randrange(1, 60)))
        parts = [symbols[k: k + size] for k in range(0, len(symbols), size)]
        tables = [[cheapest(p, b, (e,), k + 1 == len(parts)) for b in range(4) for e in range(4)] for k, p in enumerate(parts)]
        chosen = chain([[f and (f[0], r) for f, r in zip(t, ranked(t))] for t in tables])
        found = [t[c] for t, c in zip(tables, chosen)]
        assert (sum(f[0] for f in found), "".join(f[1] for f in found)) == in_order(symbols) == cheapest(symbols, NEW, ACCEPTED, True)


def want_of(rows):
    """The contract, read row by row."""
    held = {}
    for conv, turn, role, text in rows:
        mine = held.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(name.encode()) % 20
        if code == 1:
            text = ""
        elif code == 2:
            text = re.sub("[.!?]", "", text)
        elif code == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = []
    for conv, mine in held.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, symbols, faults = set(), "", []
        for _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "D" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = in_order(symbols)
        lines, state, left = [], "", list(mine)
        for edit in audit:
            role = "assistant" if state == "u" else "user"
            if edit == "I":
                lines.append(f"{role}:")
            else:
                _, was, text = left.pop(0)
                if edit == "D":
                    continue
                role = was if edit == "K" else role
                lines.append(f"{role}:{text}")
            state = role[0]
        turns = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def odd_rows():
    rng = random.Random(12)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n\t", None, "end.\n", "dots. then", ".", "é…", " \x85"]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), rng.choice(roles), rng.choice(texts)))
    rows += [(500, 7, "user", "Same row.")] * 300  # a crowd of equal rows
    for turn in range(900):  # a conversation of many blocks that holds most rows
        rows.append((600, turn, rng.choice(roles), f"text {turn}" + rng.choice([".", "", "!"])))
    return rows


def test_repair_equals_the_rules(spark, monkeypatch):
    rows = odd_rows()
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = given.selectExpr("*", "'x' AS block", "1 AS audit", "2 AS cost", "'y' AS _at", "3 AS symbols", "4 AS place")
    assert rows_of(repair_digest(damage(wide), wide), *COLUMNS) == want_of(rows)
    monkeypatch.setattr(conversations, "BLOCK", 4)
    assert rows_of(repair_digest(damage(wide), wide), *COLUMNS) == want_of(rows)


def test_repaired_rows_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Well"), (1, 2, "assistant", "So."), (2, 0, "system", "Be kind."), (3, 0, "user", "Go.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    counts, audits = solve(turns)
    assert rows_of(audits, "conv_id", "cost", "audit") == [(1, 2, "KDK"), (2, 2, "D"), (3, 2, "D")]
    assert rows_of(repaired(turns, audits), "conv_id", "place", "turn", "role", "text", "edit") == [(1, 0, 0, "user", "Hi.", "K"), (1, 1, 2, "assistant", "So.", "K")]
    assert rows_of(counts, "conv_id", "truncated", "illegal") == [(1, 1, 1), (2, 0, 0), (3, 0, 0)]
    none = turns.limit(0)
    assert repair_digest(none, none).count() == 0
    assert rows_of(repair_digest(none, turns), *COLUMNS) == [(i, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for i in (1, 2, 3)]
