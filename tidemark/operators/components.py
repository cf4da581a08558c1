"""Connected components by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import join_unique
from tidemark.session import discard, disposable, materialise

MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, root): root is the smallest node reachable.

    Each round is two grouped minima; the edge table is written between rounds,
    so the lineage stays short, and the one before it goes.  Nodes without an edge do not appear.
    """
    current = _tidy(edges)
    before = _signature(current)
    for _ in range(MAX_ROUNDS):
        with disposable(edges.sparkSession) as keep:
            following = keep(_tidy(_small_star(_large_star(current))))
        discard(current)
        current = following
        now = _signature(current)
        if now == before:
            return _leaves_and_roots(current)
        before = now
    raise RuntimeError("connected components did not settle")


def _tidy(edges: DataFrame) -> DataFrame:
    """Undirected edges once, larger node first."""
    return materialise(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )


def _signature(edges: DataFrame) -> tuple:
    # sums of 31-bit hashes, so that no sum overflows
    mixed = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return join_unique(both, least, "a", both.count()).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    edges = _tidy(edges)
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = join_unique(edges, least, "a", edges.count())
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))
    )


def _leaves_and_roots(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
