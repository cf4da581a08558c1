"""Exact linear-interpolated quantiles at any size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import prefix_sums
from tidemark.operators.skew import join_series
from tidemark.session import materialise

SMALL = 2_000_000  # values the built-in exact percentile may hold in one task
_ACCURACY = 10_000


def quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], small: int = SMALL, n: int | None = None
) -> dict[str, list[float | None]]:
    """Exact quantiles (linear interpolation, NULLs ignored) of several columns.

    Small inputs use ``percentile``.  Larger ones are narrowed: an approximate
    sketch brackets every wanted rank, exact counts confirm the bracket, and
    only values strictly inside it stay in play.  ``n`` is the row count if known.  Each round keeps about one
    value in 2 500, moves no rows, and ends with at most ``small`` values.
    """
    if n is None or n * len(cols) > small:
        counts = df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
        n = max(counts.values())
    if n * len(cols) <= small:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(*[F.percentile(F.col(c).cast("double"), wanted).alias(c) for c in cols]).first()
        return {c: (list(row[c]) if row[c] is not None else [None] * len(probs)) for c in cols}
    out: dict[str, list[float | None]] = {}
    ranks: dict[tuple[str, int], float | None] = {}
    for c in cols:
        for p in probs:
            if counts[c]:
                at = (counts[c] - 1) * p
                ranks[(c, math.floor(at))] = None
                ranks[(c, math.ceil(at))] = None
    found = _order_statistics(df, list(ranks), counts, small)
    for c in cols:
        if not counts[c]:
            out[c] = [None] * len(probs)
            continue
        values = []
        for p in probs:
            at = (counts[c] - 1) * p
            lo, hi = found[(c, math.floor(at))], found[(c, math.ceil(at))]
            values.append(lo + (hi - lo) * (at - math.floor(at)))
        out[c] = values
    return out


def _inside(c: str, low, high):
    v = F.col(c).cast("double")
    test = v.isNotNull()
    if low is not None:
        test = test & (v > F.lit(low))
    if high is not None:
        test = test & (v < F.lit(high))
    return F.when(test, v)


def _order_statistics(df, wanted, counts, small):
    """Values at 0-based ranks; ``wanted`` = [(column, rank)]."""
    found: dict[tuple[str, int], float] = {}
    # per target: open interval (low, high), values <= low, values strictly inside
    live = {t: (None, None, 0, counts[t[0]]) for t in wanted}
    share = max(1, small // max(1, len(wanted)))
    while live:
        done = [t for t, s in live.items() if s[3] <= share]
        if done:
            row = df.agg(
                *[
                    F.sort_array(F.collect_list(_inside(t[0], live[t][0], live[t][1]))).alias(f"t{i}")
                    for i, t in enumerate(done)
                ]
            ).first()
            for i, t in enumerate(done):
                found[t] = row[f"t{i}"][t[1] - live[t][2]]
                del live[t]
            if not live:
                break
        targets = list(live)
        margin = 2.0 / _ACCURACY
        # targets that share an interval share one sketch
        shared: dict[tuple, list] = {}
        for t in targets:
            shared.setdefault((t[0], *live[t][:2]), []).append(t)
        sketches = []
        for i, ((c, low, high), members) in enumerate(shared.items()):
            ends = []
            for t in members:
                q = (t[1] - live[t][2]) / live[t][3]
                ends += [F.lit(max(0.0, q - margin)), F.lit(min(1.0, q + margin))]
            sketches.append(F.percentile_approx(_inside(c, low, high), F.array(*ends), _ACCURACY).alias(f"s{i}"))
        row = df.agg(*sketches).first()
        ends_of = {}
        for i, members in enumerate(shared.values()):
            for j, t in enumerate(members):
                ends_of[t] = (row[f"s{i}"][2 * j], row[f"s{i}"][2 * j + 1])
        edges = sorted({(t[0], v) for t, pair in ends_of.items() for v in pair})
        tallies = []
        for i, (c, v) in enumerate(edges):
            x = F.col(c).cast("double")
            tallies += [F.count_if(x < F.lit(v)).alias(f"lt{i}"), F.count_if(x <= F.lit(v)).alias(f"le{i}")]
        counted = df.agg(*tallies).first()
        lt = {e: counted[f"lt{i}"] for i, e in enumerate(edges)}
        le = {e: counted[f"le{i}"] for i, e in enumerate(edges)}
        for t in targets:
            c, rank = t
            low, high, below, inside = live[t]
            a, b = ends_of[t]
            if rank < lt[c, a]:
                live[t] = (low, a, below, lt[c, a] - below)
            elif rank < le[c, a]:
                found[t] = a
            elif rank < lt[c, b]:
                live[t] = (a, b, le[c, a], lt[c, b] - le[c, a])
            elif rank < le[c, b]:
                found[t] = b
            else:
                live[t] = (b, high, le[c, b], below + inside - le[c, b])
            if t in found:
                del live[t]
    return found


def median(df: DataFrame, col: str, n: int | None = None) -> float | None:
    return quantiles(df, [col], [0.5], n=n)[col][0]


def quantiles_by(
    df: DataFrame, series: Sequence[str], col: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles per series, one row each; a series, or one value, may hold most of the table.

    Rows are counted per (series, value) first, so equal values are one row from there on.  The running
    totals over the distinct values tell which of them cover the two ranks next to each wanted one.
    """
    values = df.where(F.col(col).isNotNull()).groupBy(*series, F.col(col).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    running = materialise(prefix_sums(values, [*series, "_v"], {"_upto": "_c"}), "running")
    sizes = running.groupBy(*series).agg(F.sum("_c").alias("_n"), F.min(F.col("_upto") - F.col("_c")).alias("_first"))
    placed = join_series(running, materialise(sizes, "series-sizes"), series)
    last = F.col("_upto") - F.col("_first")  # ranks from last - _c to last - 1 have this value
    picks = []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        lo = F.max(F.when((F.floor(at) < last) & (F.floor(at) >= last - F.col("_c")), F.col("_v")))
        hi = F.max(F.when((F.ceil(at) < last) & (F.ceil(at) >= last - F.col("_c")), F.col("_v")))
        part = F.max(at - F.floor(at))
        picks.append((lo + (hi - lo) * part).alias(name))
    return placed.groupBy(*series).agg(*picks)
