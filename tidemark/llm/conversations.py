"""Repair of conversation structure: the cheapest edits that give ``(s?(ua)+)?``, found from both ends.

A conversation is a row of symbols, one for each turn: its role's initial (``s u a``, anything else ``x``), in
capitals if its text is cut off, or ``D`` if the turn is blank or a duplicate and must go.  The edit lattice has
a node for each number of turns done and state of the grammar: nothing yet, after the system turn, after a user
turn, after an assistant turn.  Keep costs 0, Rerole 1, Delete 2, Insert 5; a cut-off turn that stays costs 5 more.

Two heaps walk the lattice, one from the start and one from the accepting ends.  They stop once no path through
what is left can be as cheap as the best crossing, so all crossings of that cost are known; of these the least
forward audit followed by backward audit is taken.  Within a cost the forward heap pops by turns done, the
backward one by turns to come, since only Keep is free: every label of a node is in the heap before the first pops.

Long conversations are cut into blocks.  A block is solved for every state it may begin and end in; the chain of
blocks then needs 16 costs of each.  Edits before a turn count with that turn, so two audits of a block that end in
different states differ inside it and the choice block by block is the least one of the whole.

Order and duplicates come from turns without their texts: rows are numbered by one range shuffle, first
occurrences are an aggregate.  Texts move once, to the task that writes their conversation, where they are read
in order as a stream.  A digest of a whole conversation has to be taken in order, so one task reads all of it,
holding a batch of rows and the audit (a byte for each turn), however long the conversation is.

Defined results: turns are taken by number (NULL first), then role, then MD5 of the text; repeated rows are
duplicates of each other.  NULL texts and roles are one space.  A role without initial s, u or a cannot be kept.
NULL is a conversation like any other.  Columns beside conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import number_rows
from tidemark.operators.skew import join_series
from tidemark.session import materialise, shuffle_partitions

BLOCK = 256  # turns of a conversation solved at once
REMEMBERED = 100_000  # solved blocks a worker remembers
BLANK = r"^[\x20\x09-\x0D]*\z"
CUT_OFF = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"

NEW, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (NEW, ASSISTANT)
_KEPT = {"s": {NEW: SYSTEM}, "u": {NEW: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_GIVEN = {NEW: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what Rerole and Insert give in a state
NAMES = {USER: "user", ASSISTANT: "assistant"}

Best = tuple[int, str]


def edits(symbols: str, at: int, state: int, last: bool) -> Iterator[tuple[int, str, int, int]]:
    """(cost, initial, turns done, state) of every edit at a node; ``last`` if nothing follows the block."""
    n = len(symbols)
    if at < n or last:
        yield 5, "I", at, _GIVEN[state]
    if at < n:
        symbol = symbols[at]
        yield 2, "D", at + 1, state
        if symbol != "D":
            more = 5 if symbol.isupper() else 0
            kept = _KEPT.get(symbol.lower(), {}).get(state)
            if kept is not None:
                yield more, "K", at + 1, kept
            yield 1 + more, "R", at + 1, _GIVEN[state]


def undone(symbols: str, at: int, state: int, last: bool) -> Iterator[tuple[int, str, int, int]]:
    """The edits that lead to a node, as (cost, initial, turns done before, state before)."""
    for before in range(4):
        if at < len(symbols) or last:
            if _GIVEN[before] == state:
                yield 5, "I", at, before
        if at:
            for cost, initial, to, reached in edits(symbols, at - 1, before, last):
                if to == at and reached == state:
                    yield cost, initial, at - 1, before


def cheapest(symbols: str, begin: int, ends: tuple[int, ...], last: bool) -> Best | None:
    """Cost and least audit of the cheapest edits from ``begin`` to one of ``ends``, or None."""
    n = len(symbols)
    ahead: dict[tuple[int, int], Best] = {}
    back: dict[tuple[int, int], Best] = {}
    forward = [(0, 0, "", begin)]
    reverse = [(0, 0, "", state) for state in ends]
    heapq.heapify(reverse)
    best: Best | None = None

    def crossing(cost: int, audit: str) -> None:
        nonlocal best
        if best is None or (cost, audit) < best:
            best = cost, audit

    while forward and reverse and (best is None or forward[0][0] + reverse[0][0] <= best[0]):
        if forward[0][0] <= reverse[0][0]:
            cost, at, audit, state = heapq.heappop(forward)
            if (at, state) in ahead:
                continue
            ahead[at, state] = cost, audit
            if (at, state) in back:
                crossing(cost + back[at, state][0], audit + back[at, state][1])
            for price, initial, to, reached in edits(symbols, at, state, last):
                if (to, reached) in back:  # over this edit, whether or not its end is ever popped here
                    crossing(cost + price + back[to, reached][0], audit + initial + back[to, reached][1])
                if (to, reached) not in ahead:
                    heapq.heappush(forward, (cost + price, to, audit + initial, reached))
        else:
            cost, left, audit, state = heapq.heappop(reverse)
            at = n - left
            if (at, state) in back:
                continue
            back[at, state] = cost, audit
            if (at, state) in ahead:
                crossing(ahead[at, state][0] + cost, ahead[at, state][1] + audit)
            for price, initial, to, before in undone(symbols, at, state, last):
                if (to, before) in ahead:
                    crossing(ahead[to, before][0] + price + cost, ahead[to, before][1] + initial + audit)
                if (to, before) not in back:
                    heapq.heappush(reverse, (cost + price, n - to, initial + audit, before))
    return best


def chain(blocks: list[list[Best | None]]) -> list[int]:
    """Which entry of every block to take; ``blocks[k][4 * begin + end]`` holds cost and rank of its audit, or None."""
    to_go: list[list[int | None]] = [[0 if s in ACCEPTED else None for s in range(4)]]
    for table in reversed(blocks):
        costs = []
        for begin in range(4):
            ways = [table[4 * begin + end][0] + rest for end, rest in enumerate(to_go[-1]) if rest is not None and table[4 * begin + end] is not None]
            costs.append(min(ways) if ways else None)
        to_go.append(costs)
    to_go.reverse()
    state, out = NEW, []
    for k, table in enumerate(blocks):
        _, end = min(
            (found[1], end)
            for end, rest in enumerate(to_go[k + 1])
            if rest is not None and (found := table[4 * state + end]) is not None and found[0] + rest == to_go[k][state]
        )
        out.append(4 * state + end)
        state = end
    return out


def ranked(table: list[Best | None]) -> list[int | None]:
    """Place of each audit among those of its begin state; no two of them are equal."""
    out = []
    for k, entry in enumerate(table):
        others = [e[1] for e in table[k // 4 * 4: k // 4 * 4 + 4] if e is not None]
        out.append(None if entry is None else sorted(others).index(entry[1]))
    return out


# ---------------------------------------------------------------- the structure of conversations


def marked(turns: DataFrame) -> DataFrame:
    """Columns _initial, _fault (blank, cut, NULL) and _mark (MD5 of the text) from role and text; no text goes on."""
    return turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).select(
        "conv_id", "turn", "role", F.md5("text").alias("_mark"),
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise(F.lit("x")).alias("_initial"),
        F.when(F.col("text").rlike(BLANK), F.lit("blank")).when(F.col("text").rlike(CUT_OFF), F.lit("cut")).alias("_fault"),
    )


_ORDER = ("turn", "role", "_mark")
_SOLVED = "conv_id {kind}, block long, blocks long, costs array<long>, ranks array<int>, audits array<string>"


def _solve(batches) -> Iterator[pa.RecordBatch]:
    """Blocks of symbols: of a whole conversation one audit, of others a table of begin and end states."""
    known: dict[tuple, tuple] = {}
    for batch in batches:
        found = []
        for key in zip(*(batch.column(c).to_pylist() for c in ("symbols", "blocks", "last"))):
            symbols, blocks, last = key
            key = symbols, blocks == 1, last
            if key not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                if blocks == 1:
                    table = [cheapest(symbols, NEW, ACCEPTED, True)]
                else:
                    table = [cheapest(symbols, begin, (end,), last) for begin in range(4) for end in range(4)]
                known[key] = [e and e[0] for e in table], ranked(table), [e and e[1] for e in table]
            found.append(known[key])
        kinds = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "block", "blocks")), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))],
            ["conv_id", "block", "blocks", "costs", "ranks", "audits"],
        )


def _choose(key, table):
    """The chain of the blocks of one long conversation, an Arrow table of 16 costs and ranks for each."""
    table = table.sort_by("block")
    rows = zip(table["costs"].to_pylist(), table["ranks"].to_pylist())
    blocks = [[None if c is None else (c, r) for c, r in zip(*row)] for row in rows]
    return pa.table([table["conv_id"], table["block"], pa.array(chain(blocks), pa.int32())], names=["conv_id", "block", "entry"])


def solve(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faults and edits of conversations (conv_id, turn, role, text).

    Returns one row per conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost) and the audits
    (conv_id, block, cost, audit), whose blocks in order make up a conversation's audit.
    """
    spark = turns.sparkSession
    kind = turns.schema["conv_id"].dataType.simpleString()
    # equal rows may come in any order, but a crowd of them must not stay in one range
    salted = marked(turns).withColumn("_salt", F.monotonically_increasing_id())
    placed = materialise(number_rows(salted, [*_ORDER, "_salt"], series=["conv_id"], pos="_at")[0].drop("_salt"), "turns")
    # of equal turns the first is none: its place is the least, found without sorting a crowd of copies
    firsts = placed.where("_fault IS DISTINCT FROM 'blank'").groupBy("conv_id", "role", "_mark").agg(F.min("_at").alias("_at")).select("conv_id", "_at", F.lit(True).alias("_first"))
    same = F.col("t.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("t._at") == F.col("f._at"))
    symbol = (
        F.when((F.col("_fault") == "blank") | F.col("_first").isNull(), F.lit("D"))
        .when(F.col("_fault") == "cut", F.upper("_initial")).otherwise(F.col("_initial"))
    )
    told = placed.alias("t").join(firsts.alias("f"), same, "left").select(
        "t.conv_id", "t._at", "turn", "_initial", symbol.alias("_symbol"),
        F.when(F.col("_fault") == "blank", F.lit("blank")).when(F.col("_first").isNull(), F.lit("duplicate")).when(F.col("_fault") == "cut", F.lit("truncated")).alias("_kind"),
    )
    held = told.withColumn("block", F.floor(F.col("_at") / BLOCK)).groupBy("conv_id", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_symbol"))), lambda x: x["_symbol"]), "").alias("symbols"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_initial"))), lambda x: x["_initial"]), "").alias("initials"),
        F.min("turn").alias("low"), F.max("turn").alias("high"),
        *[F.count_if(F.col("_kind") == k).alias(k) for k in ("blank", "duplicate", "truncated")],
    )
    held = materialise(held, "blocks")
    # pairs of neighbours inside a block, and over the edge to the next one
    pairs = F.size(F.filter(F.sequence(F.lit(1), F.length("initials") - 1), lambda k: ~F.substring("initials", k, F.lit(2)).isin("su", "ua", "au")))
    inside = held.withColumn("illegal", F.when(F.length("initials") > 1, pairs).otherwise(F.lit(0)).cast("long"))
    ends = held.select("conv_id", F.col("block"), F.expr("right(initials, 1)").alias("end"))
    starts = held.where("block > 0").select("conv_id", (F.col("block") - 1).alias("block"), F.expr("left(initials, 1)").alias("start"))
    edge = F.col("e.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("e.block") == F.col("s.block"))
    over = ends.alias("e").join(starts.alias("s"), edge).where(~F.concat("end", "start").isin("su", "ua", "au")).groupBy("e.conv_id").agg(F.count(F.lit(1)).alias("over"))
    turns_seen = told.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("_one")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("seen"))
    told_of = inside.groupBy("conv_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("blocks"),
        *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal")],
    )
    counts = _with(_with(told_of, turns_seen), over)
    asked = _with(held.select("conv_id", "block", "symbols"), told_of.select("conv_id", "blocks")).withColumn("last", F.col("block") == F.col("blocks") - 1)
    solved = materialise(
        asked.select("conv_id", "block", "blocks", "last", "symbols").repartition(shuffle_partitions(spark), "conv_id", "block").mapInArrow(_solve, _SOLVED.format(kind=kind)), "solved"
    )
    long = solved.where("blocks > 1").select("conv_id", "block", "costs", "ranks")
    chosen = long.groupBy("conv_id").applyInArrow(_choose, f"conv_id {kind}, block long, entry int")
    ours = F.col("c.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("c.block") == F.col("s.block"))
    of_long = chosen.alias("c").join(solved.alias("s"), ours).select("c.conv_id", "c.block", F.expr("costs[entry]").alias("cost"), F.expr("audits[entry]").alias("audit"))
    of_short = solved.where("blocks = 1").select("conv_id", "block", F.expr("costs[0]").alias("cost"), F.expr("audits[0]").alias("audit"))
    audits = materialise(of_short.unionByName(of_long), "audits")
    costs = audits.groupBy("conv_id").agg(F.sum("cost").alias("cost"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("seen"), F.lit(0)).cast("long")
    return _with(counts, costs).select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("over", F.lit(0))).alias("illegal"), "cost"
    ), audits


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the conversation; NULL equals NULL."""
    right = right.withColumnRenamed("conv_id", "_conv")
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")


# ---------------------------------------------------------------- repaired texts


_LINES = "conv_id {kind}, place long, turn {turn}, role string, text string, edit string"


def _apply(batches) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: a conversation's audits, then its turns.  Every turn that stays and every insert goes out."""
    conv, seen, audit, at, state, place = None, False, [], 0, NEW, 0
    out: dict[str, list] = {c: [] for c in ("conv_id", "place", "turn", "role", "text", "edit")}

    def put(turn, role, text, edit) -> None:
        nonlocal place
        for c, v in zip(out, (conv, place, turn, role, text, edit)):
            out[c].append(v)
        place += 1

    def inserts() -> None:
        nonlocal at, state
        while at < len(edit_of) and edit_of[at] == "I":
            state = _GIVEN[state]
            put(None, NAMES[state], "", "I")
            at += 1

    edit_of = ""
    schema = None
    for batch in batches:
        schema = schema or pa.schema([
            ("conv_id", batch.schema.field("conv_id").type), ("place", pa.int64()), ("turn", batch.schema.field("turn").type),
            *((c, pa.string()) for c in ("role", "text", "edit")),
        ])
        for c, piece, turn, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "audit", "turn", "role", "text"))):
            if not seen or c != conv:
                if seen:
                    edit_of = edit_of or "".join(audit)
                    inserts()
                conv, seen, audit, edit_of, at, state, place = c, True, [], "", 0, NEW, 0
            if piece is not None:
                audit.append(piece)
                continue
            edit_of = edit_of or "".join(audit)
            inserts()
            edit = edit_of[at]
            at += 1
            if edit == "K":
                state = _KEPT[role[0]][state]
                put(turn, role, text, "K")
            elif edit == "R":
                state = _GIVEN[state]
                put(turn, NAMES[state], text, "R")
        if len(out["place"]):
            yield pa.RecordBatch.from_arrays([pa.array(v, schema.field(c).type) for c, v in out.items()], schema=schema)
            for v in out.values():
                v.clear()
    if seen:
        edit_of = edit_of or "".join(audit)
        inserts()
        if len(out["place"]):
            yield pa.RecordBatch.from_arrays([pa.array(v, schema.field(c).type) for c, v in out.items()], schema=schema)


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place, turn, role, text, edit: the turns of repaired conversations, in order within a partition.

    A conversation lies in one partition.  Inserted turns have no number and an empty text.
    """
    spark = turns.sparkSession
    kind, number = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = turns.select("conv_id", F.lit(None).cast("long").alias("block"), F.lit(None).cast("string").alias("audit"), "turn", role.alias("role"), F.md5(text).alias("_mark"), text.alias("text"))
    told = audits.select("conv_id", "block", "audit", F.lit(None).cast(number).alias("turn"), *[F.lit(None).cast("string").alias(c) for c in ("role", "_mark", "text")])
    order = [F.col("conv_id").asc(), F.col("block").asc_nulls_last(), *[F.col(c).asc() for c in _ORDER]]
    dealt = told.unionByName(rows).repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "audit", "turn", "role", "text").mapInArrow(_apply, _LINES.format(kind=kind, turn=number))


def _digest(batches) -> Iterator[pa.RecordBatch]:
    """One digest per conversation of a partition that holds whole conversations in order."""
    conv, digest, type_ = None, None, None
    for batch in batches:
        type_ = batch.schema.field("conv_id").type
        done = []
        for c, place, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "place", "role", "text"))):
            if place == 0:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], type_), pa.array([d for _, d in done])], ["conv_id", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], type_), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])


def repair_digest(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Counts, cost, audit and digest for every conv_id of ``conversations``; those without turns have zeros and nothing."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    counts, audits = solve(turns)
    digests = repaired(turns, audits).select("conv_id", "place", "role", "text").mapInArrow(_digest, f"conv_id {kind}, repaired_sha256 string")
    whole = audits.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit")
    )
    every = conversations.select("conv_id").distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return _with(_with(_with(every, counts), whole), digests).select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damage(conversations: DataFrame) -> DataFrame:
    """Turns with faults put in by a hash of conversation and turn: dropped, emptied, unpunctuated, repeated, user's."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    code = F.crc32(F.concat_ws(":", *named)) % 20
    text = F.coalesce("text", F.lit(" "))
    hit = conversations.select("conv_id", "turn", "role", "text", code.alias("_code")).where("_code <> 0")
    return hit.select(
        "conv_id", "turn",
        F.when(F.col("_code") == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("_code") == 1, F.lit("")).when(F.col("_code") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("_code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")
