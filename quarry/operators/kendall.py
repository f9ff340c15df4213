"""Exact Kendall tau-b without emitting pairs.

S = sum over pairs of sign(dx) * sign(dy). A group of rows is split into slabs of x and
slabs of y at quantile edges, and its pairs into three disjoint parts:

* different x-slab and different y-slab: the sign of each difference is the
  sign of the slab difference, so this part follows from the counts of the slab grid,
  a table of bounded size for each group;
* same x-slab: every x-slab is a group of its own in the next round;
* same y-slab, different x-slab: every y-slab is a group in the next round, with the
  number of the x-slab in place of x (pairs of equal number contribute 0).

Rounds go on until a group holds at most ``slab_rows`` rows, which one task counts by
merging, vectorised level by level. A value equal to an edge gets a slab of its own, so
a heavy tie (say a third of all rows on one value) sits in a single-value slab whose
inner pairs contribute 0: such slabs are dropped, and no task ever holds a hot group.
Each round splits a group into some 2 * 256 + 1 slabs, so the rounds grow with the
logarithm of the rows. Tie corrections n1, n2 are grouped counts.
"""

from __future__ import annotations

from itertools import combinations
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.exprs import bounded_broadcast, to_double
from quarry.session import cut_lineage

N_SLABS = 256
SLAB_ROWS = 500_000


def _tie_pairs(sorted_vals: np.ndarray) -> int:
    if len(sorted_vals) < 2:
        return 0
    _, c = np.unique(sorted_vals, return_counts=True)
    return int((c * (c - 1) // 2).sum())


def _inversions(b: np.ndarray) -> int:
    """Pairs i < j with b[i] > b[j] (strict). Ranks are told apart bit by bit: among
    ranks that agree above a bit, each one without it counts the earlier ones with it."""
    if len(b) < 2:
        return 0
    rank = np.unique(b, return_inverse=True)[1].astype(np.int64)
    total = 0
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        above = rank >> (bit + 1)
        order = np.argsort(above, kind="stable")
        one = (rank[order] >> bit) & 1
        before = np.cumsum(one) - one
        head = np.flatnonzero(np.concatenate(([True], above[order][1:] != above[order][:-1])))
        start = np.repeat(before[head], np.diff(np.append(head, len(b))))
        total += int(((before - start) * (1 - one)).sum())
    return total


def s_pairs(a: np.ndarray, b: np.ndarray) -> int:
    """sum_{i<j} sign(a_i - a_j) * sign(b_i - b_j), ties contributing 0."""
    m = len(a)
    if m < 2:
        return 0
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    n0 = m * (m - 1) // 2
    n1 = _tie_pairs(a)
    n2 = _tie_pairs(np.sort(b))
    same = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]])
    runs = np.diff(np.nonzero(same)[0])
    n3 = int((runs * (runs - 1) // 2).sum())
    return n0 - n1 - n2 + n3 - 2 * _inversions(b)


def _slab(v: Column, edges: Column) -> Column:
    """Number of a value's slab: even between edges, odd on an edge."""
    below = F.size(F.filter(edges, lambda e: e < v))
    return (2 * below + F.array_contains(edges, v).cast("int")).cast("int")


def _grid_sum(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of different x-slab and different y-slab of one group's grid."""
    ai, a = np.unique(pdf["sa"].to_numpy(), return_inverse=True)
    bi, b = np.unique(pdf["sb"].to_numpy(), return_inverse=True)
    G = np.zeros((len(ai), len(bi)), np.int64)
    np.add.at(G, (a, b), pdf["count"].to_numpy())
    after = np.zeros((len(ai) + 1, len(bi)), np.int64)
    after[:-1] = np.cumsum(G[::-1], axis=0)[::-1]
    after = after[1:]  # rows of larger a
    left = np.cumsum(after, axis=1)
    down = left - after  # columns of smaller b
    up = left[:, -1:] - left  # columns of larger b
    # whole numbers beyond 64 bits, as text
    return pd.DataFrame({"s": [str(sum(int(x) * int(y) for x, y in zip(G[G > 0], (up - down)[G > 0])))]})


def s_statistic(data: DataFrame, n_slabs: int = N_SLABS, slab_rows: int = SLAB_ROWS) -> int:
    """S of the rows (x, y), both without nulls."""
    data = cut_lineage(data.select(F.lit("").alias("g"), F.col("x").alias("a"), F.col("y").alias("b")))
    total = 0

    def add(parts: DataFrame) -> int:
        return int(parts.agg(F.sum(F.col("s").cast("decimal(38,0)"))).first()[0] or 0)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [str(s_pairs(pdf["a"].to_numpy(), pdf["b"].to_numpy()))]})
    while True:
        sizes = data.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        probs = [i / n_slabs for i in range(1, n_slabs)]
        large = sizes.where(F.col("n") > slab_rows)
        total += add(data.join(large.select("g"), "g", "left_anti").groupBy("g").applyInPandas(whole, "s string"))
        if large.isEmpty():
            return total
        rest = cut_lineage(data.join(large.select("g"), "g", "left_semi"))
        edges = cut_lineage(rest.groupBy("g").agg(*[F.array_distinct(F.percentile_approx(c, probs, 10_000)).alias(f"e{c}") for c in "ab"]))
        placed = cut_lineage(rest.join(bounded_broadcast(edges, 10_000), "g")
                             .select("g", "a", "b", _slab(F.col("a"), F.col("ea")).alias("sa"), _slab(F.col("b"), F.col("eb")).alias("sb")))
        total += add(placed.groupBy("g", "sa", "sb").count().groupBy("g").applyInPandas(_grid_sum, "s string"))
        by_x = placed.where("sa % 2 = 0").select(F.concat_ws("/", "g", F.concat(F.lit("x"), "sa")).alias("g"), "a", "b")
        by_y = placed.where("sb % 2 = 0").select(F.concat_ws("/", "g", F.concat(F.lit("y"), "sb")).alias("g"),
                                                 F.col("sa").cast("double").alias("a"), "b")
        data = cut_lineage(by_x.union(by_y))


def kendall_pair(df: DataFrame, cx: str, cy: str, n_slabs: int = N_SLABS, slab_rows: int = SLAB_ROWS) -> float | None:
    data = df.select(to_double(cx).alias("x"), to_double(cy).alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull())

    def ties(c):
        return data.groupBy(c).count().agg(F.sum((F.col("count") * (F.col("count") - 1) / 2).cast("decimal(38,0)"))).first()[0] or 0
    n = data.count()
    if n < 2:
        return None
    n0 = n * (n - 1) // 2
    n1, n2 = int(ties("x")), int(ties("y"))
    s = s_statistic(data, n_slabs, slab_rows)
    den = (n0 - n1) * (n0 - n2)
    return s / float(den) ** 0.5 if den > 0 else None


def kendall_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A7 long form (col_a, col_b, r) incl. the diagonal, like the other methods."""
    rows = []
    for c in cols:
        nd = df.agg(F.count_distinct(to_double(c))).first()[0]
        rows.append((c, c, 1.0 if nd and nd > 1 else None))
    for a, b in combinations(cols, 2):
        t = kendall_pair(df, a, b)
        t = None if t is None else float(min(1.0, max(-1.0, t)))
        rows += [(a, b, t), (b, a, t)]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, r double")
