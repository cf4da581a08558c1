"""How sources of a language differ in their words: exact divergences from counts of equal count cells.

Terms are read in Arrow batches and counted in the task before anything is shuffled, so a word that every text
holds costs a row per source and flush of a task.  One shuffle by (lang, term) then settles which terms are kept
(in three documents of the language at least) and brings a term's sources together.

The probability of a term depends on its count only.  So terms fall into cells: for a group against its language,
(count in the group, count in the language); for two groups, both counts.  f is evaluated once a cell:

* Terms of a group: cells of equal f are merged to a level, levels are ranked by the number of terms above them,
  and only cells of levels that begin within the first ranks are expanded to terms, in UTF-8 order.
* Pairs of groups: with f(a, b) for a term counted a and b times, the sum over all kept terms is
  V f(0, 0) + sum over the first group's terms of f(a, 0) - f(0, 0), the same for the second's, + sum over common
  terms of f(a, b) - f(a, 0) - f(0, b) + f(0, 0).  So only terms that both have are ever looked at in pairs, as
  cells counted before the shuffle; the rest comes from the two histograms of counts.

Sums are decimals of 38 digits and divisions integral; nothing is rounded.

Defined results: NULL text, lang and source are ''.  Every row is a document, repeated rows and rows without id
too.  Groups without terms have pairs; a language with one source has none.  Without documents there is nothing.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import NO_LETTER, Words, pieces, row_of, text_bytes
from tidemark.session import materialise, shuffle_partitions

HELD = 300_000  # counted terms a task holds before it sends them on
LEAST_DOCUMENTS = 3
RANKS = 200
SCALE = 1_000_000_000

_COUNTED = "lang string, source string, term string, n long, docs long"
_SCHEMA = pa.schema([*((c, pa.string()) for c in ("lang", "source", "term")), ("n", pa.int64()), ("docs", pa.int64())])


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


class _Counter:
    """Counts by group and hash of the term; the bytes of each term are kept once."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.held: list[tuple[np.ndarray, ...]] = []
        self.terms: dict[int, bytes] = {}
        self.n = 0

    def add(self, group: np.ndarray, words: Words) -> None:
        """``group`` of each document of the words."""
        if not len(words.start):
            return
        hashes, doc = words.hashes(), row_of(words.first)
        order = np.lexsort((doc, hashes, group[doc]))
        g, h, d = group[doc][order], hashes[order], doc[order]
        first = _runs(g, h)
        n = np.diff(np.append(first, len(g)))
        docs = np.add.reduceat(np.concatenate([[1], ((d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])).astype(np.int64)]), first)
        self.held.append((g[first], h[first], n, docs))
        self.n += len(first)
        new, where = np.unique(h[first], return_index=True)
        at = order[first[where]]
        data = words.data.tobytes()
        for key, a, b in zip(new.tolist(), words.start[at].tolist(), words.end[at].tolist()):
            if key not in self.terms:
                self.terms[key] = data[a:b]

    def fold(self) -> None:
        """Add up what was counted more than once."""
        g, h, n, docs = (np.concatenate([x[i] for x in self.held]) for i in range(4))
        order = np.lexsort((h, g))
        g, h, n, docs = g[order], h[order], n[order], docs[order]
        first = _runs(g, h)
        self.held = [(g[first], h[first], np.add.reduceat(n, first), np.add.reduceat(docs, first))]
        self.n = len(first)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.fold()
            g, h, n, docs = self.held[0]
            names = list(self.groups)
            langs, sources = (pa.array([x[i] for x in names], pa.string()).take(pa.array(g)) for i in (0, 1))
            terms = pa.array([self.terms[x] for x in h.tolist()], pa.binary()).cast(pa.string())
            whole = pa.RecordBatch.from_arrays([langs, sources, terms, pa.array(n), pa.array(docs)], schema=_SCHEMA)
            for at in range(0, len(whole), 50_000):
                yield whole.slice(at, 50_000)
        self.__init__()


def _count(batches) -> Iterator[pa.RecordBatch]:
    counter = _Counter()
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
        for low, high in pieces(offsets):
            group = np.array([counter.groups.setdefault(x, len(counter.groups)) for x in names[low:high]], np.int64)
            counter.add(group, Words(data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low], NO_LETTER, lower=True))
            if counter.n >= 2 * HELD:
                counter.fold()
                if counter.n >= HELD:
                    yield from counter.flush()
    yield from counter.flush()


def kept_terms(docs: DataFrame) -> DataFrame:
    """lang, term, total, groups (array of source and n): the terms of each language that enough documents hold."""
    counted = docs.select("lang", "source", "text").mapInArrow(_count, _COUNTED)
    by_source = counted.repartition(shuffle_partitions(docs.sparkSession), "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups")
    ).where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs")


def _exact(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def _share(count: Column, size: Column) -> Column:
    """p of a count; ``size`` is N + V, at least 1 where there is a kept term."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * _exact(count + 1), _exact(F.nullif(size, F.lit(0))))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergences(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank; see the module."""
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = materialise(kept_terms(docs), "terms")
    by_group = terms.select("lang", "term", "total", F.inline("groups"))
    # cells of a group's terms: how often here, how often in the language, and how many terms
    cells = materialise(by_group.groupBy("lang", "source", "n", "total").agg(F.count(F.lit(1)).alias("m")), "cells")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("whole"))
    sizes = cells.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("size"))
    every = docs.select("lang", "source").distinct()
    groups = materialise(
        every.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "v", "whole")]), "groups"
    )
    return _term_part(by_group, cells, groups, ranks).unionByName(_pair_part(terms, cells, groups))


def _term_part(by_group: DataFrame, cells: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    p, q = _share(F.col("n"), F.col("size") + F.col("v")), _share(F.col("total"), F.col("whole") + F.col("v"))
    valued = cells.join(groups, ["lang", "source"]).select("lang", "source", "n", "total", "m", p.alias("p"), q.alias("q")).where("p > q")
    valued = materialise(valued.select("lang", "source", "n", "total", "m", _gap(F.col("p"), F.col("q")).alias("value")), "valued")
    # a level has a term at least, so levels beyond the first ``ranks`` hold no rank that is asked for
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    levels = valued.groupBy("lang", "source", "value").agg(F.sum("m").alias("m")).withColumn("_nth", F.row_number().over(down)).where(F.col("_nth") <= ranks)
    above = F.coalesce(F.sum("m").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.withColumn("above", above).where(F.col("above") < ranks).select("lang", "source", "value", "above")
    chosen = valued.join(levels, ["lang", "source", "value"]).select("lang", "source", "n", "total", "value", "above")
    inside = Window.partitionBy("lang", "source", "value").orderBy("term")
    expanded = by_group.join(chosen, ["lang", "source", "n", "total"]).withColumn("_in", F.row_number().over(inside)).where(F.col("_in") <= ranks)
    rank = (F.col("above") + F.col("_in")).cast("int")
    return expanded.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", rank.alias("rank")).where(F.col("rank") <= ranks)


def _pair_part(terms: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    # a term's sources are sorted, so each two of them come once; the row of one source goes on with those behind it
    one = terms.where(F.size("groups") > 1).select("lang", "groups", F.posexplode("groups").alias("at", "x"))
    two = one.select("lang", "x", F.explode(F.slice("groups", F.col("at") + 2, F.size("groups"))).alias("y"))
    both = two.select("lang", F.col("x.source").alias("g"), F.col("y.source").alias("h"), F.col("x.n").alias("a"), F.col("y.n").alias("b"))
    both = materialise(both.groupBy("lang", "g", "h", "a", "b").agg(F.count(F.lit(1)).alias("m")), "common")
    size = groups.select("lang", "source", "v", (F.col("size") + F.col("v")).alias("size"))
    counts = cells.groupBy("lang", "source", "n").agg(F.sum("m").alias("m")).join(size, ["lang", "source"])
    of = lambda name: [F.col("source").alias(name), F.col("size").alias(f"size_{name}"), _share(F.lit(0).cast("long"), F.col("size")).alias(f"none_{name}")]
    # what two groups need of each other: their p of a term that is missing
    pairs = materialise(size.select("lang", "v", *of("g")).join(size.select("lang", *of("h")), "lang").where("g <> h"), "pairs")
    nothing = _gap(F.col("none_g"), F.col("none_h"))
    big = lambda c: c.cast("decimal(20,0)")
    base = pairs.select("lang", "g", "h", (big(F.col("v")) * big(F.coalesce(nothing, F.lit(0)))).cast("decimal(38,0)").alias("part"))
    here = counts.select("lang", F.col("source").alias("g"), "m", _share(F.col("n"), F.col("size")).alias("p"))
    first = pairs.join(here, ["lang", "g"]).select("lang", "g", "h", (big(F.col("m")) * big(_gap(F.col("p"), F.col("none_h")) - nothing)).cast("decimal(38,0)").alias("part"))
    there = here.withColumnRenamed("g", "h")
    second = pairs.join(there, ["lang", "h"]).select("lang", "g", "h", (big(F.col("m")) * big(_gap(F.col("none_g"), F.col("p")) - nothing)).cast("decimal(38,0)").alias("part"))
    either = both.unionByName(both.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), F.col("b").alias("a"), F.col("a").alias("b"), "m"))
    p, q = _share(F.col("a"), F.col("size_g")), _share(F.col("b"), F.col("size_h"))
    more = either.join(pairs, ["lang", "g", "h"]).select("lang", "g", "h", "m", p.alias("p"), q.alias("q"), "none_g", "none_h")
    change = big(_gap(F.col("p"), F.col("q"))) - big(_gap(F.col("p"), F.col("none_h"))) - big(_gap(F.col("none_g"), F.col("q"))) + big(nothing)
    common = more.select("lang", "g", "h", (big(F.col("m")) * big(change)).cast("decimal(38,0)").alias("part"))
    parts = base.unionByName(first).unionByName(second).unionByName(common)
    summed = parts.groupBy("lang", "g", "h").agg(F.sum("part").cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "g").orderBy(F.desc("value"), F.asc("h")))
    return summed.select("lang", F.col("g").alias("source"), F.lit("pair").alias("part"), F.col("h").alias("item"), "value", rank.alias("rank"))
