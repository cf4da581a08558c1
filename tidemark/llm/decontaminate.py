"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed looks at some of the words in its span and ignores the others, so a hit survives replaced words at
the ignored places.  The seeds of the benchmark meet the seeds at every word of the training texts; around
a hit the two texts are compared word by word along the same alignment.  The masks of every length of a
compared window are so many that each way to replace up to a fifth of its words leaves one of them a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import disposable, materialise

#: 1: the word counts, 0: it may differ.
MASKS = ("1101011011", "1110010111")
SPAN = len(MASKS[0])
WINDOW = 16  # words compared at most around a hit
#: Further masks by the number of words compared.  With MASKS (from 10 words on) they leave no pattern of replaced
#: words without a hit; the tests enumerate the patterns.
_LONG, _MIDDLE = ("1110111", "11001000111"), ("1110111",)
FURTHER = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("111", "1101"), 6: ("1111", "11011"), 7: ("11011",), 8: ("111011", "11111"),
    9: ("1111011", "1101111"), 10: ("110111", "11100011"), 11: ("110111", "11111"), 12: ("1110111", "111111"), 13: _MIDDLE, 14: _MIDDLE, 15: _LONG, 16: _LONG,
}
BEFORE = max(size - len(mask) for size, masks in FURTHER.items() for mask in masks)  # words before a hit that a window may begin with
SHARE = 0.8  # of them that must be equal
BLOCK = 1_000_000  # benchmark seeds that are sent to every task at once
MASKS_AT_ONCE = 4  # masks of one pass; more would make generated code too large to be compiled


def word_hashes(text: Column) -> Column:
    """Lower-cased words between ASCII spaces, as 64-bit hashes; NULL text has none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masks_of(compared: int) -> tuple[str, ...]:
    """The masks that find every window of so many words."""
    return (MASKS if compared >= SPAN else ()) + FURTHER[compared]


def _places(hashes: Column, span: int) -> Column:
    size = F.size(hashes)
    return F.explode(F.when(size >= span, F.sequence(F.lit(0), size - span)))


def _seed(mask: str, hashes: Column, place: Column) -> Column:
    """NULL where the mask reaches beyond the text."""
    words = (F.get(hashes, place + i) for i, c in enumerate(mask) if c == "1")
    return F.when(place + len(mask) <= F.size(hashes), F.xxhash64(F.lit(mask), *words))


def _seeds(masks: list[str], hashes: Column, place: Column) -> Column:
    """The seed of every mask at a place; plain expressions, so that they stay inside generated code."""
    return F.explode(F.array(*(_seed(mask, hashes, place) for mask in masks)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _tag, item_id, start, matched, compared): benchmark items that a document holds, once each.

    After a seed hit the item is laid over the document there, and of the windows of 16 words of the item that
    hold the hit (the whole item if it is shorter; places beyond the document's ends count as different) the
    one with most equal words decides: ``matched`` of ``compared`` words, at least 80 %.  ``start`` is the
    word of the document that the item's first word lies on, negative if the item begins before the
    document.  Of several hits the best counts, of equal ones the first.

    Every window with so many equal words has a hit, so the result is that of laying every item over every
    place.  Items of up to 4 words must occur word for word.  NULL texts have no words.  Benchmark
    rows that share an item_id are judged one by one and reported together, as are documents that share id
    and text; ``_tag`` is a hash of the text that tells apart others.  NULL ids are kept as they are.

    The training texts are not shuffled: the benchmark's seeds go to every task in blocks of at most
    ``BLOCK``, and a larger benchmark takes more passes, as does one whose items have many lengths under 16.
    """
    hashed = benchmark.select(F.col("item_id"), word_hashes(F.col("text")).alias("_item")).where(F.size("_item") > 0)
    size = F.size("_item")
    compared = F.least(size, F.lit(WINDOW))
    hashed = materialise(hashed.withColumn("compared", compared), "items")
    lengths = sorted(r["compared"] for r in hashed.select("compared").distinct().collect()) or [WINDOW]
    masks = sorted({mask for n in lengths for mask in masks_of(n)})
    seeds = None
    for number, mask in enumerate(masks):
        span = len(mask)
        placed = hashed.where(F.col("compared").isin([n for n in lengths if mask in masks_of(n)]))
        placed = placed.select("item_id", "_item", "compared", _places(F.col("_item"), span).alias("_at"))
        placed = placed.select(
            "item_id", "_at", _around(F.col("_item"), F.col("_at")).alias("_near"), "compared",
            (F.greatest(F.lit(0), F.col("_at") + span - F.col("compared")) - F.col("_at") + BEFORE).alias("_low"),
            (F.least(F.col("_at"), size - F.col("compared")) - F.col("_at") + BEFORE).alias("_high"),
            _seed(mask, F.col("_item"), F.col("_at")).alias("_seed"), F.lit(number // MASKS_AT_ONCE).alias("_pass"),
        )
        seeds = placed if seeds is None else seeds.unionByName(placed)
    seeds = materialise(seeds.distinct(), "seeds")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    rows = rows.select("doc_id", F.xxhash64("_text").alias("_tag"), word_hashes(F.col("_text")).alias("_words"))
    found = None
    for first in range(0, len(masks), MASKS_AT_ONCE):
        some = masks[first: first + MASKS_AT_ONCE]
        placed = rows.select("doc_id", "_tag", "_words", _places(F.col("_words"), min(map(len, some))).alias("_p"))
        placed = placed.select("doc_id", "_tag", "_words", "_p", _seeds(some, F.col("_words"), F.col("_p")).alias("_seed"))
        theirs = seeds.where(F.col("_pass") == first // MASKS_AT_ONCE).drop("_pass")
        blocks = max(1, -(-theirs.count() // BLOCK))
        for block in range(blocks):
            part = theirs.where(F.pmod(F.xxhash64("_seed"), F.lit(blocks)) == block) if blocks > 1 else theirs
            hits = _verified(placed, part)
            found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("doc_id", "_tag", "item_id").agg(
        F.max(F.struct("_holds", "matched", (-F.col("start")).alias("_late"), "compared")).alias("_best")
    )
    return best.where("_best._holds").select("doc_id", "_tag", "item_id", (-F.col("_best._late")).alias("start"), "_best.matched", "_best.compared")


def _around(hashes: Column, place: Column) -> Column:
    """The words from ``BEFORE`` before a place to 16 from it on; NULL beyond the text."""
    return F.array(*(F.get(hashes, place + i) for i in range(-BEFORE, WINDOW)))


def _verified(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every hit with the best count of equal words and whether it suffices.

    Explode and join are one piece of generated code that stays small enough to be compiled; it cuts the
    words around a hit out of the document, so that no hit carries all words of its document.  Whether a
    hit holds is only asked after the aggregation, for a condition on it would move into the join.
    """
    hits = rows.join(F.broadcast(seeds), "_seed")
    first = F.greatest(F.col("_p") - BEFORE, F.lit(0))
    hits = hits.select(
        "doc_id", "_tag", "item_id", (F.col("_p") - F.col("_at")).alias("start"), "compared", "_low", "_high", "_near",
        F.slice("_words", first + 1, F.lit(BEFORE + WINDOW)).alias("_around"), (F.col("_p") - first - BEFORE).alias("_lead"),
    )
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(BEFORE + WINDOW - 1)), F.lit(0),
        lambda total, k: total + F.when(
            (k + F.col("_lead") < F.size("_around")) & (F.get("_around", k + F.col("_lead")) == F.get("_near", k)), F.call_function("shiftleft", F.lit(1), k)
        ).otherwise(F.lit(0)),
    )
    hits = hits.select("doc_id", "_tag", "item_id", "start", "compared", "_low", "_high", bits.alias("_bits"))
    # equal words of the window that begins at place a of the neighbourhood
    whole = F.expr("shiftleft(1, compared) - 1")
    sums = [
        F.when((F.col("_low") <= a) & (F.col("_high") >= a), F.bit_count(F.col("_bits").bitwiseAND(whole * (1 << a)))).otherwise(F.lit(0))
        for a in range(BEFORE + 1)
    ]
    hits = hits.select("doc_id", "_tag", "item_id", "start", "compared", F.greatest(*sums).alias("matched"))
    return hits.withColumn("_holds", F.col("matched") >= SHARE * F.col("compared"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, that hold no benchmark item (see ``find_leaks``)."""
    with disposable(docs.sparkSession) as keep:
        leaks = keep(materialise(find_leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_leak_id"), F.col("_tag").alias("_leak_tag")).distinct(), "leaks"))
    same = docs[id_col].eqNullSafe(leaks["_leak_id"]) & (F.xxhash64(docs[text_col]) == leaks["_leak_tag"])
    return docs.join(leaks, same, "left_anti")


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    leaks = find_leaks(docs, benchmark)
    return leaks.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("compared").alias("compared"))


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_MASKS = sorted({mask for n in range(1, WINDOW + 1) for mask in masks_of(n)})
_SEED = "concat_ws(' ', {words}) AS seed FROM (SELECT id, w, len(w) AS n, unnest(range(0, len(w) - {less})) AS p FROM {table} WHERE len(w) > {less}{only})"


def _seeds_sql(table: str) -> str:
    """Seeds of every mask; of an item only by the masks for its number of compared words."""
    parts = []
    for k, mask in enumerate(_MASKS):
        only = f" AND least(len(w), {WINDOW}) IN ({', '.join(str(n) for n in range(1, WINDOW + 1) if mask in masks_of(n))})" if table == "b" else ""
        words = ", ".join(f"w[p + {i + 1}]" for i, c in enumerate(mask) if c == "1")
        parts.append(f"SELECT id, p, n, {k} AS k, {len(mask)} AS span, " + _SEED.format(words=words, less=len(mask) - 1, table=table, only=only))
    return " UNION ALL ".join(parts)


LEAKS_SQL = f"""
WITH d AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id AS id, {_WORDS} AS w FROM benchmark),
ds AS ({_seeds_sql("d")}),
bs AS ({_seeds_sql("b")}),
hits AS (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.p - bs.p AS start, bs.p AS q, bs.span, bs.n AS size, least(bs.n, {WINDOW}) AS compared
         FROM ds JOIN bs ON ds.k = bs.k AND ds.seed = bs.seed),
laid AS (SELECT *, unnest(range(greatest(0, q + span - compared), least(q, size - compared) + 1)) AS a FROM hits),
held AS (SELECT doc_id, item_id, compared, list_sum(list_transform(range(a, a + compared),
           lambda i: CASE WHEN start + i >= 0 AND d.w[start + i + 1] = b.w[i + 1] THEN 1 ELSE 0 END)) AS matched
         FROM laid JOIN d ON d.id = doc_id JOIN b ON b.id = item_id)
SELECT doc_id, item_id, CAST(max(matched) AS INTEGER) AS matched, CAST(max(compared) AS INTEGER) AS compared
FROM held WHERE matched >= {SHARE} * compared GROUP BY doc_id, item_id"""
