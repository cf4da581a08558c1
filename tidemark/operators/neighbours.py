"""Exact nearest-neighbour and radius joins.

Identical vectors are collapsed to points first, so copies cost nothing.  Every
point goes to its nearest pivot; triangle-inequality bounds on the pivots then
tell which reference points can matter to which query cell (the partition-based
kNN join of Lu, Shen, Chen and Ooi, 2012).  Cells are cut into chunks of bounded
size, so a crowded region becomes many tasks; every task returns at most k
candidates per query, or one count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sampling import md5_sample
from tidemark.operators.skew import join_unique
from tidemark.session import materialise, shuffle_partitions

MAX_PIVOTS = 1024
LOW_DIMENSION = 8
QUERY_CHUNK = 2048
REF_CHUNK = 8192
CHUNK_BYTES = 16 << 20  # numbers of one side of a group in many dimensions
CHUNKS = 8  # per side at least, so that there is work for every core
_SLACK = 1e-6  # bounds are loosened by this share against rounding


@dataclass(frozen=True)
class Points:
    """``table``: pid (smallest id), v, ids (smallest ``keep`` ids), copies."""

    table: DataFrame
    rows: DataFrame  # row_id, v
    n_points: int
    n_rows: int

    def spread(self, per_point: DataFrame) -> DataFrame:
        """Bring columns known per ``pid`` to every row: row_id, pid, ..."""
        if self.n_points == self.n_rows:
            return per_point.withColumn("row_id", F.col("pid"))
        keyed = self.table.select("pid", F.col("v").alias("_key"))
        rows = self.rows.select("row_id", F.col("v").alias("_key"))
        return join_unique(rows, keyed.join(per_point, "pid"), "_key", self.n_rows).drop("_key")


def distinct_points(df: DataFrame, vector: Column, row_id: str = "row_id", keep: int = 1) -> Points:
    rows = df.select(F.col(row_id).alias("row_id"), vector.alias("v"))
    w = Window.partitionBy("v").orderBy("row_id")
    # the rank limit is applied before the shuffle, so a hot vector sends `keep` rows per task
    kept = (
        rows.withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= keep)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("row_id")).alias("ids"))
    )
    copies = rows.groupBy("v").agg(F.count(F.lit(1)).alias("copies"))
    table = materialise(
        kept.join(copies, "v")
        .select(F.col("ids")[0].alias("pid"), "v", "ids", "copies")
        .repartition(shuffle_partitions(df.sparkSession), "pid"),
        "points",
    )
    size = table.agg(F.count(F.lit(1)).alias("p"), F.sum("copies").alias("r")).first()
    return Points(table, rows, size["p"], size["r"] or 0)


def _to_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot (``cell``) and the distance to it (``far``)."""

    def assign(batches):
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy())
                d2 = (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)[None, :]
                cell = d2.argmin(1)
                far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield batch.assign(cell=cell.astype("int32"), far=far)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInPandas(assign, f"{schema}, cell int, far double")


@dataclass
class _Layout:
    """Which (query cell, query chunk, reference bin) groups exist, and who joins them."""

    pivots: np.ndarray
    bound: np.ndarray  # per query cell: no neighbour that counts is farther than this
    ball: np.ndarray  # per query cell: distance from its pivot within which such rows lie
    slack: float
    q_chunks: np.ndarray
    bin_of: list[np.ndarray]  # per ref cell: bins of its sub-chunks
    bins_for: list[np.ndarray]  # per query cell
    n_bins: int
    max_chunks: int

    def wanted(self, x: np.ndarray, far: np.ndarray) -> np.ndarray:
        """[row, query cell]: can this reference row be a neighbour of a query there?

        It must lie in the ball around the cell's pivot, and, as the queries are closer to
        that pivot than to the row's own, not more than twice the bound beyond its own distance.
        """
        d2 = (x**2).sum(1)[:, None] - 2 * x @ self.pivots.T + (self.pivots**2).sum(1)[None, :]
        edge = np.minimum(self.ball[None, :], far[:, None] + 2 * self.bound[None, :])
        return np.sqrt(np.maximum(d2, 0.0)) <= edge + self.slack

    def code(self, cell, chunk, bin_):
        return (cell * self.max_chunks + chunk) * self.n_bins + bin_


def _chunk_rows(d: int, n: int) -> tuple[int, int]:
    """Rows of a query chunk and of a reference bin.

    In many dimensions almost every chunk meets every bin, so a row is sent once per chunk of the other side:
    chunks are as large as memory allows, where there are enough of them.
    """
    if d <= LOW_DIMENSION:
        return QUERY_CHUNK, REF_CHUNK
    rows = min(CHUNK_BYTES // (8 * d), n // CHUNKS)
    return max(rows, QUERY_CHUNK), max(rows, REF_CHUNK)


def _layout(pivots, q_stats, r_stats, nearest, k, radius, n_refs) -> _Layout:
    query_chunk, ref_chunk = _chunk_rows(pivots.shape[1], n_refs)
    m = len(pivots)
    gap = np.sqrt(np.maximum(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(2), 0.0))
    q_count, q_far = np.zeros(m, dtype=np.int64), np.zeros(m)
    q_count[q_stats["cell"]] = q_stats["n"]
    q_far[q_stats["cell"]] = q_stats["far"]
    r_count, r_far = np.zeros(m, dtype=np.int64), np.full(m, -1.0)
    r_count[r_stats["cell"]] = r_stats["n"]
    r_far[r_stats["cell"]] = r_stats["far"]
    bound = np.full(m, np.inf if radius is None else float(radius))
    if k is not None and len(nearest) >= k:
        n_cell, n_far = nearest["cell"].to_numpy(), nearest["far"].to_numpy()
        for c in np.flatnonzero(q_count):
            upper = np.partition(gap[c, n_cell] + n_far, k - 1)[k - 1] + q_far[c]
            bound[c] = min(bound[c], upper)
    slack = _SLACK * (1.0 + gap.max() + max(q_far.max(), r_far.max()))
    bound[q_count == 0] = -np.inf
    q_chunks = np.maximum(1, -(-q_count // query_chunk))
    bin_of, filled, current = [], 0, 0
    for c in range(m):
        subs = max(1, -(-int(r_count[c]) // ref_chunk))
        each = r_count[c] / subs
        mine = []
        for _ in range(subs):
            if filled and filled + each > ref_chunk:
                current, filled = current + 1, 0
            mine.append(current)
            filled += each
        bin_of.append(np.array(mine))
    edge = np.minimum((q_far + bound)[:, None], r_far[None, :] + 2 * bound[:, None])
    usable = (gap - r_far[None, :] <= edge + slack) & (r_count > 0)[None, :]
    bins_for = [
        np.unique(np.concatenate([bin_of[r] for r in np.flatnonzero(row)])) if row.any() else np.array([], int)
        for row in usable
    ]
    return _Layout(pivots, bound, q_far + bound, slack, q_chunks, bin_of, bins_for, current + 1, int(q_chunks.max()))


def _group_keys(layout: _Layout, side: str):
    @F.pandas_udf("array<bigint>")
    def query_keys(pid: pd.Series, cell: pd.Series, far: pd.Series) -> pd.Series:
        chunk = _mix(pid.to_numpy()) % layout.q_chunks[cell.to_numpy()]
        return pd.Series(
            [layout.code(c, ch, layout.bins_for[c]) for c, ch in zip(cell.to_numpy().astype(np.int64), chunk)]
        )

    @F.pandas_udf("array<bigint>")
    def ref_keys(pid: pd.Series, cell: pd.Series, far: pd.Series, v: pd.Series) -> pd.Series:
        if not len(pid):
            return pd.Series([], dtype=object)
        mixed = _mix(pid.to_numpy())
        bins = np.array([layout.bin_of[r][p % len(layout.bin_of[r])] for p, r in zip(mixed, cell.to_numpy())])
        row, to = np.nonzero(layout.wanted(np.stack(v.to_numpy()), far.to_numpy()))
        chunks = layout.q_chunks[to]
        row, to = np.repeat(row, chunks), np.repeat(to, chunks)
        within = np.arange(len(to)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        keys = layout.code(to, within, bins[row])
        return pd.Series(np.split(keys, np.searchsorted(row, np.arange(1, len(pid)))))

    return query_keys if side == "query" else ref_keys


def _mix(ids: np.ndarray) -> np.ndarray:
    """Spread consecutive ids over chunks (multiplicative hashing)."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(33)).astype(np.int64)


def _grouped(queries: DataFrame, refs: DataFrame, n_refs: int, k, radius, ref_cols, query_cols=()):
    """Co-grouped query and reference chunks, or None if a side is empty."""
    size = min(MAX_PIVOTS, max(1, int(math.sqrt(max(n_refs, 1)))))
    chosen = md5_sample(refs.select("pid", "v"), "pid", size, n_refs, "pivot").toPandas()
    if chosen.empty:
        return None
    pivots = np.stack(chosen["v"].to_numpy())
    if pivots.shape[1] > LOW_DIMENSION:
        # bounds prune little in many dimensions, and every cell is one more copy of the references
        pivots = pivots[: max(1, min(size // 4, n_refs // (4 * _chunk_rows(pivots.shape[1], n_refs)[0])))]
    # neighbouring cells get neighbouring numbers, so that they share bins
    pivots = pivots[np.argsort(pivots[:, pivots.var(axis=0).argmax()], kind="stable")]
    q = materialise(_to_cells(queries.select("pid", "v", *query_cols), pivots), "query-cells")
    r = materialise(_to_cells(refs.select("pid", "v", *ref_cols), pivots), "ref-cells")
    stats = [t.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).toPandas() for t in (q, r)]
    if stats[0].empty:
        return None
    nearest = pd.DataFrame({"cell": [], "far": []})
    if k is not None:
        by_cell = Window.partitionBy("cell").orderBy("far")
        nearest = (
            r.select("cell", "far")
            .withColumn("_r", F.row_number().over(by_cell))
            .where(F.col("_r") <= k)
            .select("cell", "far")
            .toPandas()
        )
    layout = _layout(pivots, *stats, nearest, k, radius, n_refs)
    left = q.select(F.explode(_group_keys(layout, "query")("pid", "cell", "far")).alias("group"), "pid", "v", *query_cols)
    right = r.select(
        F.explode(_group_keys(layout, "ref")("pid", "cell", "far", "v")).alias("group"),
        F.col("pid").alias("nbr"), "v", *ref_cols,
    )
    parts = shuffle_partitions(queries.sparkSession)
    left, right = left.repartition(parts, "group"), right.repartition(parts, "group")
    return left.groupBy("group").cogroup(right.groupBy("group"))


def _distances(x: np.ndarray, y: np.ndarray):
    """Blocks of squared distances by matrix product, with the rounding they carry."""
    step = max(16, min(512, 512 * REF_CHUNK // max(len(y), 1)))
    xx, yy = (x**2).sum(1), (y**2).sum(1)
    for at in range(0, len(x), step):
        part = slice(at, min(at + step, len(x)))
        d2 = xx[part, None] - 2 * x[part] @ y.T + yy[None, :]
        yield part, np.maximum(d2, 0.0), 1e-9 * (xx[part].max() + yy.max() + 1e-300)


def _no_rows(**types: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype=t) for c, t in types.items()})


_KNN_SCHEMA = "pid bigint, nbr bigint, dist double, ids array<bigint>"


def knn_points(queries: DataFrame, refs: DataFrame, n_refs: int, k: int, radius: float | None = None) -> DataFrame:
    """The ``k`` nearest reference points of every query point (a point finds itself too).

    ``queries`` has pid, v; ``refs`` has pid, v, ids.  With ``radius`` only
    neighbours within it are returned.  Ties go to the smaller id.
    """

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _no_rows(pid="int64", nbr="int64", dist="float64", ids="object")
        right = right.sort_values("nbr", ignore_index=True)
        x, y = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        pid, nbr, ids = left["pid"].to_numpy(), right["nbr"].to_numpy(), right["ids"].to_numpy()
        parts = []
        for part, d2, tolerance in _distances(x, y):
            if len(y) > k:
                edge = np.partition(d2, k - 1, axis=1)[:, k - 1 : k] + tolerance
            else:
                edge = np.full((len(d2), 1), np.inf)
            if radius is not None:
                edge = np.minimum(edge, radius**2 + tolerance)
            row, col = np.nonzero(d2 <= edge)
            exact = np.sqrt(((x[part][row] - y[col]) ** 2).sum(1))
            if radius is not None:
                keep = exact <= radius
                row, col, exact = row[keep], col[keep], exact[keep]
            order = np.lexsort((nbr[col], exact, row))
            row, col, exact = row[order], col[order], exact[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            top = rank < k
            parts.append((pid[part][row[top]], col[top], exact[top]))
        at = np.concatenate([p[1] for p in parts])
        return pd.DataFrame(
            {
                "pid": np.concatenate([p[0] for p in parts]),
                "nbr": nbr[at],
                "dist": np.concatenate([p[2] for p in parts]),
                "ids": ids[at],
            }
        )

    groups = _grouped(queries, refs, n_refs, k, radius, ["ids"])
    if groups is None:
        return queries.sparkSession.createDataFrame([], _KNN_SCHEMA)
    w = Window.partitionBy("pid").orderBy("dist", "nbr")
    return (
        groups.applyInPandas(best, _KNN_SCHEMA)
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= k)
        .drop("_r")
    )


def radius_counts_points(queries: DataFrame, refs: DataFrame, n_refs: int, radius: float) -> DataFrame:
    """Rows within ``radius`` of every query point, copies and the point itself counted."""

    def tally(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _no_rows(pid="int64", n="int64")
        x, y = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        copies = right["copies"].to_numpy()
        out = np.zeros(len(x), dtype=np.int64)
        for part, d2, tolerance in _distances(x, y):
            sure = d2 <= radius**2 - tolerance
            row, col = np.nonzero((d2 <= radius**2 + tolerance) & ~sure)
            hit = np.sqrt(((x[part][row] - y[col]) ** 2).sum(1)) <= radius
            sure[row[hit], col[hit]] = True
            out[part] = sure @ copies
        return pd.DataFrame({"pid": left["pid"], "n": out})

    groups = _grouped(queries, refs, n_refs, None, radius, ["copies"])
    if groups is None:
        return queries.sparkSession.createDataFrame([], "pid bigint, n bigint")
    return groups.applyInPandas(tally, "pid bigint, n bigint").groupBy("pid").agg(F.sum("n").alias("n"))


def radius_links(points: DataFrame, n: int, radius: float) -> DataFrame:
    """Edges (a, b) that connect the same ``node`` values as all pairs within ``radius``.

    ``points`` has pid, v, node.  A task returns a spanning forest of its chunk
    pair, at most one edge per node, never the pairs themselves.
    """

    def forest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _no_rows(a="int64", b="int64")
        x, y = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        nodes, at = np.unique(np.concatenate([left["node"], right["node"]]), return_inverse=True)
        at_x, at_y = at[: len(x)], at[len(x) :]
        root = np.arange(len(nodes))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for part, d2, tolerance in _distances(x, y):
            row, col = np.nonzero(d2 <= radius**2 + tolerance)
            exact = np.sqrt(((x[part][row] - y[col]) ** 2).sum(1)) <= radius
            pairs = np.unique(at_x[part][row[exact]] * len(nodes) + at_y[col[exact]])
            for i, j in zip(pairs // len(nodes), pairs % len(nodes)):
                i, j = find(i), find(j)
                if i != j:
                    root[max(i, j)] = min(i, j)
        top = np.array([find(i) for i in range(len(nodes))])
        moved = top != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[moved], "b": nodes[top[moved]]})

    groups = _grouped(points, points, n, None, radius, ["node"], ["node"])
    if groups is None:
        return points.sparkSession.createDataFrame([], "a bigint, b bigint")
    return groups.applyInPandas(forest, "a bigint, b bigint")


def knn_join(df: DataFrame, vector: Column, k: int, row_id: str = "row_id") -> DataFrame:
    """Exact k nearest other rows of every row: row_id, nbr_id, dist, rank."""
    points = distinct_points(df, vector, row_id, keep=k + 1)
    near = knn_points(points.table, points.table, points.n_points, k + 1)
    w = Window.partitionBy("pid").orderBy("dist", "nbr_id")
    candidates = (
        near.select("pid", "dist", F.explode("ids").alias("nbr_id"))
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= k + 1)
        .groupBy("pid")
        .agg(F.sort_array(F.collect_list(F.struct("dist", "nbr_id"))).alias("near"))
    )
    others = F.slice(F.filter("near", lambda x: x["nbr_id"] != F.col("row_id")), 1, k)
    return (
        points.spread(candidates)
        .select("row_id", F.posexplode(others).alias("at", "hit"))
        .select("row_id", F.col("hit.nbr_id").alias("nbr_id"), F.col("hit.dist").alias("dist"),
                (F.col("at") + 1).alias("rank"))
    )


def radius_counts(df: DataFrame, vector: Column, radius: float, row_id: str = "row_id") -> DataFrame:
    """Rows within ``radius`` of every row, itself included: row_id, n."""
    points = distinct_points(df, vector, row_id)
    counts = radius_counts_points(points.table, points.table, points.n_points, radius)
    return points.spread(counts).select("row_id", "n")
