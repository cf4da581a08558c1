"""Connected components of points within a radius, found cell by cell.

Points of one grid cell are linked anyway, so a cell is one node.  The first points of the cells are joined first;
then only cells of different components whose boxes come close enough are compared, each pair by halving both
sides and dropping halves that are too far apart.  So the pairs of points within the radius, of which a crowded
table has quadratically many, are never walked through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.components import components
from tidemark.operators.neighbours import _distances, _grouped, _no_rows, radius_links
from tidemark.operators.skew import join_unique
from tidemark.session import materialise, shuffle_partitions

BUCKET_ROWS = 100_000  # rows of cell pairs that are compared in one group
LEAF = 4096  # distances taken at once when two cells are compared
_ROUNDING = 1e-9


def linked_cells(points: DataFrame, n_points: int, radius: float) -> DataFrame:
    """node, root: the smallest node that chains of points within ``radius`` reach.

    ``points`` has pid, v, node; a node is the smallest pid of its cell, whose diagonal is at most ``radius``.
    """
    heads = points.where("pid = node").select("pid", "v", "node")
    n_nodes = heads.count()
    first = components(radius_links(heads, n_nodes, radius))
    if n_nodes == n_points:
        return heads.select("node").join(first, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    d = len(points.select("v").first()["v"])
    ends = points.groupBy("node").agg(
        F.array(*[F.min(F.col("v")[i]) for i in range(d)]).alias("lo"), F.array(*[F.max(F.col("v")[i]) for i in range(d)]).alias("hi")
    )
    boxes = materialise(ends.join(first, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "lo", "hi"), "cell-boxes")
    known = boxes.select("node", "root")
    pairs = materialise(_facing(boxes, n_nodes, radius), "cell-pairs")
    if not pairs.limit(1).count():
        return known
    again = components(_touching(points, n_points, pairs, boxes, radius))
    final = again.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    return join_unique(known, known.select("root").distinct().join(final, "root", "left"), "root", n_nodes).select(
        "node", F.coalesce("_top", "root").alias("root")
    )


def _facing(boxes: DataFrame, n: int, radius: float) -> DataFrame:
    """Pairs (a, b) of cells of different components whose boxes are within ``radius``."""

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _no_rows(a="int64", b="int64")
        x, y = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        sides = [np.stack(t[c].to_numpy()) for t in (left, right) for c in ("lo", "hi")]
        a, b = left["pid"].to_numpy(), right["nbr"].to_numpy()
        root_a, root_b = left["root"].to_numpy(), right["root"].to_numpy()
        found = []
        for part, d2, tolerance in _distances(x, y):
            apart = (root_a[part, None] != root_b[None, :]) & (a[part, None] < b[None, :])
            row, col = np.nonzero((d2 <= (2 * radius) ** 2 * (1 + _ROUNDING) + tolerance) & apart)
            row = row + part.start
            gap = np.maximum(np.maximum(sides[0][row] - sides[3][col], sides[2][col] - sides[1][row]), 0.0)
            close = np.sqrt((gap**2).sum(1)) <= radius * (1 + _ROUNDING)
            found.append((a[row[close]], b[col[close]]))
        return pd.DataFrame({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})

    middle = F.zip_with("lo", "hi", lambda x, y: (x + y) / 2)
    centred = materialise(boxes.select(F.col("node").alias("pid"), middle.alias("v"), "root", "lo", "hi"), "cell-centres")
    held = ["root", "lo", "hi"]
    # no point is farther from the middle of its box than radius / 2
    groups = _grouped(centred, centred, n, None, 2 * radius * (1 + _ROUNDING), held, held)
    return groups.applyInPandas(near, "a bigint, b bigint")


def _touching(points: DataFrame, n_points: int, pairs: DataFrame, boxes: DataFrame, radius: float) -> DataFrame:
    """Edges (a, b) between the roots of those pairs of cells that have points within ``radius`` of each other."""
    places = {s: boxes.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))
              for s in "ab"}
    told = materialise(pairs.join(places["a"], "a").join(places["b"], "b"), "cell-pairs-told")

    def side(own: str, other: str) -> DataFrame:
        outside = F.zip_with(
            F.zip_with(f"lo_{other}", "v", lambda lo, x: lo - x), F.zip_with("v", f"hi_{other}", lambda x, hi: x - hi),
            lambda under, over: F.greatest(under, over, F.lit(0.0)),
        )
        gap = F.sqrt(F.aggregate(outside, F.lit(0.0), lambda s, x: s + x * x))
        beside = told.select(F.col(own).alias("node"), "a", "b", "root_a", "root_b", f"lo_{other}", f"hi_{other}")
        return (
            points.select("node", "v").join(beside, "node").where(gap <= F.lit(radius * (1 + _ROUNDING)))
            .select("a", "b", "root_a", "root_b", F.lit(own == "a").alias("left"), "v")
        )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b", "left"], ignore_index=True)
        a, b, left = (pdf[c].to_numpy() for c in ("a", "b", "left"))
        v = np.stack(pdf["v"].to_numpy())
        starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        joined = set()
        for start, stop in zip(starts, [*starts[1:], len(pdf)]):
            cut = start + int((~left[start:stop]).sum())
            edge = (int(pdf["root_a"].iat[start]), int(pdf["root_b"].iat[start]))
            if start < cut < stop and edge not in joined and touch(v[start:cut], v[cut:stop], radius):
                joined.add(edge)
        return pd.DataFrame(sorted(joined), columns=["a", "b"], dtype="int64")

    both = side("a", "b").unionByName(side("b", "a"))
    parts = shuffle_partitions(points.sparkSession)
    buckets = max(4 * parts, n_points // BUCKET_ROWS)
    spread = both.withColumn("_bucket", F.pmod(F.xxhash64("a", "b"), F.lit(buckets))).repartition(parts, "_bucket")
    return spread.groupBy("_bucket").applyInPandas(compare, "a bigint, b bigint")


def touch(x: np.ndarray, y: np.ndarray, radius: float) -> bool:
    """Is a row of ``x`` within ``radius`` of a row of ``y``?"""
    open_ = [(x, y)]
    while open_:
        x, y = open_.pop()
        low, high = x.min(0), x.max(0)
        gap = np.maximum(np.maximum(y.min(0) - high, low - y.max(0)), 0.0)
        if np.sqrt((gap**2).sum()) > radius * (1 + _ROUNDING):
            continue
        if len(x) * len(y) <= LEAF:
            if (np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)) <= radius).any():
                return True
            continue
        if len(x) < len(y):
            x, y, low, high = y, x, y.min(0), y.max(0)
        half = len(x) // 2
        order = np.argpartition(x[:, (high - low).argmax()], half)
        open_ += [(x[order[:half]], y), (x[order[half:]], y)]
    return False
