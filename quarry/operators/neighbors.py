"""Distance joins and neighbour-based models.

Exact joins that prune space before any row is copied. Rows with a missing or not
finite feature meet nothing.

* Radius joins use grid cells of the radius over at most ``GRID_DIMS`` features (the
  ones with most spread in units of the radius): a query goes to its own cell, a
  reference to its own and the adjoining ones, so a row has at most
  ``3 ** GRID_DIMS`` copies whatever the number of rows.
* k-nearest joins use pivots (rows of least hash): every reference belongs to the
  cell of its nearest pivot. A first pass meets each query with its own cell, which
  bounds its k-th distance; the triangle and half-space inequalities then tell which
  other cells can hold something nearer, and only those get a copy of the query, with
  the bound: they return what lies within it. A tile works slices of ``SLICE`` distances
  by matrix products; what their rounding can't rule out is measured directly.
* Other cells of a radius join are dealt by hash to groups of about ``block_rows`` rows,
  so that a task works many small cells at once, in batches of whole cells.
* Cells of more than ``block_rows`` rows on a side are cut by hash into chunks of
  queries and blocks of references; a task holds one of each. Copies of one point
  beyond the k + 1 smallest ids can be no one's neighbours and are left out where
  cells are crowded.
* Where only sums, counts or minima of neighbours are wanted (radius regression,
  density clustering, mean shift), tiles return those per query: pairs are never
  stored.
"""

from __future__ import annotations

import math
from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.exprs import all_true, bounded_broadcast, col, to_double
from quarry.functions.quantiles import quantile
from quarry.session import cut_lineage

BLOCK_ROWS = 4096
KNN_ROWS = 1 << 14     # queries, and references, of a tile of a k-nearest join
KNN_VALUES = 1 << 21   # and values of their features
SLICE = 1 << 20        # distances held at a time
SENT = 1 << 12         # copies of queries returned at a time
BATCH_PAIRS = 1 << 18  # pairs of a batch of small cells
GRID_DIMS = 3
MAX_PIVOTS = 1024


def vector_columns(df: DataFrame, vec_col: str, dim: int, prefix: str = "x") -> tuple[DataFrame, list[str]]:
    """Array/vector column -> ``dim`` double columns (JVM side)."""
    names = [f"{prefix}{i}" for i in range(dim)]
    return df.select("*", *[col(vec_col)[i].cast("double").alias(n) for i, n in enumerate(names)]), names


def _points(df: DataFrame, id_col: str, feats: Sequence[str], *extra: Column) -> DataFrame:
    """(id, v, extra...) of the rows whose features are all finite."""
    cols = [to_double(f) for f in feats]
    return (df.where(all_true([F.abs(c) < float("inf") for c in cols]))
            .select(col(id_col).cast("long").alias("id"), F.array(*cols).alias("v"), *extra))


def _dist_tile(Q: np.ndarray, R: np.ndarray) -> np.ndarray:
    # direct differences (no |a|^2 - 2ab + |b|^2 cancellation)
    out = np.empty((len(Q), len(R)))
    step = max(1, 2_000_000 // max(1, R.size))
    for s in range(0, len(Q), step):
        d = Q[s:s + step, None, :] - R[None, :, :]
        out[s:s + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float)


def _batches(qc: np.ndarray, rc: np.ndarray):
    """(queries, references) of batches of whole cells, given the cell of every row: up to
    ``BATCH_PAIRS`` pairs unless one cell has more. Cells of one side only are left out."""
    order = [np.argsort(c, kind="stable") for c in (qc, rc)]
    cells = np.intersect1d(qc, rc)
    lo, hi = ([np.searchsorted(c[o], cells, side) for c, o in zip((qc, rc), order)] for side in ("left", "right"))
    n = [h - l for h, l in zip(hi, lo)]
    a = 0
    while a < len(cells):
        pairs = np.cumsum(n[0][a:a + BATCH_PAIRS]) * np.cumsum(n[1][a:a + BATCH_PAIRS])
        b = a + max(1, int(np.searchsorted(pairs, BATCH_PAIRS, "right")))
        yield tuple(o[np.repeat(l[a:b] - np.cumsum(k[a:b]) + k[a:b], k[a:b]) + np.arange(k[a:b].sum())]
                    for o, l, k in zip(order, lo, n))
        a = b


def _meet(q: DataFrame, r: DataFrame, cell: Sequence[str], fn: Callable, schema: str, block_rows: int,
          groups: int = 0) -> DataFrame:
    """``fn(queries, references)`` on every pair of a chunk and a block that share a
    cell. Crowded cells are counted first; their table is broadcast if it is small.
    With ``groups`` all other cells are dealt to that many groups: ``fn`` gets a group's
    rows and finds their cells in the columns ``cell``."""
    cell = list(cell)
    # columns of its own for each side: a table may meet itself
    q, r = (d.select(*[F.col(c).alias(c) for c in d.columns]) for d in (q, r))
    load = (q.groupBy(*cell).agg(F.count(F.lit(1)).alias("__nq")).join(r.groupBy(*cell).agg(F.count(F.lit(1)).alias("__nr")), cell)
            .where((F.col("__nq") > block_rows) | (F.col("__nr") > block_rows))
            .select(*cell, F.ceil(F.col("__nq") / block_rows).cast("int").alias("__chunks"),
                    F.ceil(F.col("__nr") / block_rows).cast("int").alias("__blocks")))
    load = bounded_broadcast(load)
    chunks, blocks = F.coalesce("__chunks", F.lit(1)), F.coalesce("__blocks", F.lit(1))

    def part(n):
        return F.pmod(F.xxhash64("id", F.lit(7)), n).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), n - 1))
    crowded = F.col("__chunks").isNotNull()
    q = q.join(load, cell, "left").withColumns({"__c": part(chunks), "__crowded": crowded}).withColumn("__b", every(blocks)).drop("__chunks", "__blocks")
    r = r.join(load, cell, "left").withColumns({"__b": part(blocks), "__crowded": crowded}).withColumn("__c", every(chunks)).drop("__chunks", "__blocks")
    names = [f.split()[0] for f in schema.split(", ")]

    def tile(qdf: pd.DataFrame, rdf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or rdf.empty:
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
        return fn(qdf, rdf)
    keys = [*cell, "__c", "__b"]
    if groups:
        keys = [f"__k{i}" for i in range(len(cell) + 1)]
        q, r = (d.select("*", *[F.when(F.col("__crowded"), F.col(c)).otherwise(0).alias(k) for c, k in zip(cell, keys)],
                         F.when(F.col("__crowded"), F.lit(-1)).otherwise(F.pmod(F.xxhash64(*cell), F.lit(groups))).alias(keys[-1]))
                for d in (q, r))
        keys += ["__c", "__b"]
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(tile, schema)


# ---------------------------------------------------------------- radius


def _grid(points: DataFrame, n_feats: int, radius: float) -> tuple[list[int], float]:
    """Features of the grid and the cells' side. The side is a little over the radius,
    so that rounding can't put two rows of this distance two cells apart."""
    x = [F.col("v")[i] for i in range(n_feats)]
    st = points.agg(*[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)],
                    *[F.max(F.abs(c)).alias(f"m{i}") for i, c in enumerate(x)]).first()
    spread = sorted(((st[f"s{i}"] or 0.0, i) for i in range(n_feats)), key=lambda t: (-t[0], t[1]))
    dims = [i for s, i in spread[:GRID_DIMS] if s > 0.25 * radius]
    far = max((st[f"m{i}"] or 0.0 for i in dims), default=0.0)
    return dims, max(radius * (1 + 1e-6), far * 1e-9, 1e-300)


def radius_tiles(queries: DataFrame, refs: DataFrame, n_feats: int, radius: float, fn: Callable, schema: str,
                 block_rows: int = BLOCK_ROWS, grid: tuple | None = None) -> DataFrame:
    """``fn(queries, references, near)`` for the tiles of a radius join of two tables
    (id, v, ...); ``near`` tells which pairs lie within the radius. A pair is in
    exactly one tile, a query in as many as its cell has blocks."""
    dims, side = grid or _grid(refs, n_feats, radius)
    cell = [f"__g{k}" for k in range(len(dims))] or ["__g"]
    own = [F.floor(F.col("v")[i] / F.lit(side)) for i in dims] or [F.lit(0)]
    q = queries.select("*", *[c.alias(n) for c, n in zip(own, cell)])
    r = refs.select("*", *[c.alias(n) for c, n in zip(own, cell)])
    for n in cell if dims else []:
        r = r.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))

    names = [f.split()[0] for f in schema.split(", ")]

    def tile(qdf, rdf):
        _, code = np.unique(np.concatenate((qdf[cell].to_numpy(), rdf[cell].to_numpy())), axis=0, return_inverse=True)
        qc, rc = code[:len(qdf)], code[len(qdf):]
        Q, R, out = _matrix(qdf["v"]), _matrix(rdf["v"]), []
        for a, b in _batches(qc, rc):
            near = (_dist_tile(Q[a], R[b]) <= radius) & (qc[a][:, None] == rc[b][None, :])
            out.append(fn(qdf.iloc[a], rdf.iloc[b], near))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
    groups = max(1, math.ceil(max(queries.count(), refs.count() * 3 ** len(dims)) / block_rows))
    return _meet(q, r, cell, tile, schema, block_rows, groups)


def radius_join(queries: DataFrame, refs: DataFrame, qid: str, rid: str, feats: Sequence[str],
                radius: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All (query, reference) pairs with distance <= radius."""
    q, r = _points(queries, qid, feats), _points(refs, rid, feats)

    def pairs(qdf, rdf, near):
        a, b = np.nonzero(near)
        Q, R = _matrix(qdf["v"]), _matrix(rdf["v"])
        d = Q[a] - R[b]
        return pd.DataFrame({"q": qdf["id"].to_numpy()[a], "r": rdf["id"].to_numpy()[b], "dist": np.sqrt(np.einsum("ij,ij->i", d, d))})
    return radius_tiles(q, r, len(feats), radius, pairs, "q long, r long, dist double", block_rows)


# ---------------------------------------------------------------- k nearest


def _pair_distances(Q: np.ndarray, R: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(row))
    step = max(1, SLICE // max(1, Q.shape[1]))
    for s in range(0, len(row), step):
        d = Q[row[s:s + step]] - R[at[s:s + step]]
        out[s:s + step] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _nearest(Q: np.ndarray, R: np.ndarray, qi: np.ndarray, ri: np.ndarray, k: int, exclude_self: bool,
             bound: np.ndarray):
    """(row, column, distance) of the k nearest references of every query, ties to the
    smaller id, in slices. ``bound``: what is farther isn't wanted (not finite: unknown)."""
    p = Q.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        middle = R.mean(axis=0)
        A, B = Q - middle, R - middle
        a, b = (np.einsum("ij,ij->i", x, x) for x in (A, B))
        direct = not np.isfinite(a.max() + b.max())  # squares that overflow
    by_id = np.argsort(ri, kind="stable")
    lo, hi = (np.searchsorted(ri[by_id], qi, side) for side in ("left", "right"))
    step = max(1, SLICE // len(R))
    for s in range(0, len(Q), step):
        part = slice(s, s + step)
        if direct:
            with np.errstate(over="ignore", invalid="ignore"):
                D = _dist_tile(Q[part], R)
            slack, limit = np.zeros(len(D)), bound[part] * (1 + 1e-9)
        else:
            D = A[part] @ B.T
            D *= -2
            D += b
            D += a[part, None]
            # more than the rounding errors of D and of the direct distances
            slack = (p + 8) * 2.0 ** -50 * (a[part] + b.max()) + 1e-290
            with np.errstate(over="ignore"):
                limit = bound[part] ** 2 * (1 + 1e-9) + slack
        if exclude_self:
            n = hi[part] - lo[part]
            D[np.repeat(np.arange(len(n)), n), by_id[np.repeat(lo[part] - np.cumsum(n) + n, n) + np.arange(n.sum())]] = np.inf
        unknown = ~np.isfinite(limit)
        limit[unknown] = np.inf
        if len(R) > k and unknown.any():
            limit[unknown] = np.partition(D[unknown], k - 1, axis=1)[:, k - 1] + 2 * slack[unknown]
        row, at = np.nonzero(D <= limit[:, None])
        row += s
        if exclude_self:
            other = qi[row] != ri[at]
            row, at = row[other], at[other]
        with np.errstate(over="ignore", invalid="ignore"):
            dist = _pair_distances(Q, R, row, at)
        order = np.lexsort((ri[at], dist, row))
        row, at, dist = row[order], at[order], dist[order]
        keep = (np.arange(len(row)) - np.searchsorted(row, row) < k) & np.isfinite(dist)
        yield row[keep], at[keep], dist[keep]


def _nearest_in_cells(q: DataFrame, r: DataFrame, k: int, exclude_self: bool, block_rows: int) -> DataFrame:
    """(q, r, dist): the k nearest references of each query in each block of a cell they
    share; with a column ``bound`` only those within it."""
    bounded = "bound" in q.columns

    def tile(qdf, rdf):
        qi, ri = qdf["id"].to_numpy(), rdf["id"].to_numpy()
        bound = qdf["bound"].to_numpy(float) if bounded else np.full(len(qi), np.inf)
        row, at, dist = (np.concatenate(x) for x in zip(*_nearest(
            _matrix(qdf["v"]), _matrix(rdf["v"]), qi, ri, k, exclude_self, bound)))
        return pd.DataFrame({"q": qi[row], "r": ri[at], "dist": dist})
    return _meet(q, r, ["cell"], tile, "q long, r long, dist double", block_rows)


def _best(cand: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy("dist", "r")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _cells_of(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``cell``, the nearest pivot, and ``far``, the distance to it."""
    def run(it):
        for pdf in it:
            out = pdf
            if len(pdf):
                D = _dist_tile(_matrix(pdf["v"]), pivots)
                out = pdf.assign(cell=D.argmin(axis=1).astype("int32"), far=D.min(axis=1))
            else:
                out = pdf.assign(cell=np.zeros(0, "int32"), far=np.zeros(0))
            yield out
    return points.mapInPandas(run, "id long, v array<double>, cell int, far double")


def _wanted_cells(Q: np.ndarray, own: np.ndarray, bound: np.ndarray, pivots: np.ndarray, radii: np.ndarray,
                  sizes: np.ndarray, need: int) -> list[np.ndarray]:
    """Cells other than a query's own that can hold one of its nearest. ``radii`` and
    ``sizes``: largest distance to the pivot in each cell, and its rows (0: empty)."""
    D = _dist_tile(Q, pivots)
    # whatever the first pass found: enough rows lie within the distance to a pivot plus its radius
    reach = np.where(sizes > 0, D + radii, np.inf)
    order = np.argsort(reach, axis=1, kind="stable")
    enough = np.cumsum(sizes[order], axis=1) >= need
    first = np.where(enough.any(axis=1), enough.argmax(axis=1), len(sizes) - 1)
    roof = reach[np.arange(len(Q)), order[np.arange(len(Q)), first]]
    roof = np.where(enough.any(axis=1), roof, np.inf)
    bound = np.minimum(bound, roof) * (1 + 1e-9)
    between = _dist_tile(pivots, pivots)[own]
    half = (D ** 2 - D[np.arange(len(Q)), own][:, None] ** 2) / (2 * np.where(between > 0, between, np.inf))
    slack = 1e-9 * (1 + np.abs(D))
    can = (D - radii - slack <= bound[:, None]) & (half - slack <= bound[:, None]) & (sizes > 0)
    can[np.arange(len(Q)), own] = False
    return [np.flatnonzero(row) for row in can]


def _pivots(refs: DataFrame, n: int) -> np.ndarray:
    rows = refs.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(n).collect()
    return np.unique(np.array([r["v"] for r in rows], float), axis=0)


def knn_candidates(queries: DataFrame, refs: DataFrame, k: int, exclude_self: bool, block_rows: int,
                   n_pivots: int) -> tuple[DataFrame, DataFrame | None]:
    """Candidates (q, r, dist) that hold every query's k nearest, and the copies (id, v,
    cell) that queries sent to cells other than their own."""
    one = [d.withColumn("cell", F.lit(0)) for d in (queries, refs)]
    if n_pivots < 2:
        return _nearest_in_cells(*one, k, exclude_self, block_rows), None
    pivots = _pivots(refs, n_pivots)
    if len(pivots) < 2:
        return _nearest_in_cells(one[0], _few_copies(one[1], k), k, exclude_self, block_rows), None
    r = cut_lineage(_cells_of(refs, pivots))
    stats = r.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()
    if max(s["n"] for s in stats) > 4 * block_rows:
        r = cut_lineage(_few_copies(r, k))
    sizes, radii = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for s in stats:
        # copies that were left out don't count: a bound from fewer rows is only wider
        sizes[s["cell"]], radii[s["cell"]] = s["n"], s["radius"]
    if max(s["n"] for s in stats) > 4 * block_rows:
        for s in r.groupBy("cell").count().collect():
            sizes[s["cell"]] = s["count"]
    r = r.drop("far")
    q = cut_lineage(_cells_of(queries, pivots).drop("far"))
    near = cut_lineage(_best(_nearest_in_cells(q, r, k, exclude_self, block_rows), k))
    bounds = near.where(F.col("rank") == k).select(F.col("q").alias("id"), F.col("dist").alias("bound"))
    wide = q.join(bounds, "id", "left")

    def run(it):
        for pdf in it:
            if not len(pdf):
                continue
            for a in range(0, len(pdf), 1024):
                part = pdf.iloc[a:a + 1024]
                cells = _wanted_cells(_matrix(part["v"]), part["cell"].to_numpy(), part["bound"].fillna(np.inf).to_numpy(float),
                                      pivots, radii, sizes, k + exclude_self)
                n = np.fromiter(map(len, cells), np.int64, len(cells))
                at = np.repeat(np.arange(len(part)), n)
                cell = np.concatenate(cells).astype("int32") if len(at) else np.zeros(0, "int32")
                for b in range(0, len(at), SENT):
                    yield part[["id", "v"]].iloc[at[b:b + SENT]].assign(
                        cell=cell[b:b + SENT], bound=part["bound"].to_numpy(float)[at[b:b + SENT]])[["id", "v", "cell", "bound"]]
    # not stored: finding the cells again takes less than writing a copy of each query per cell
    sent = wide.mapInPandas(run, "id long, v array<double>, cell int, bound double")
    more = _nearest_in_cells(sent, r, k, exclude_self, block_rows)
    return near.select("q", "r", "dist").union(more), sent


def _few_copies(refs: DataFrame, k: int) -> DataFrame:
    """Of equal points only the k + 1 smallest ids (Spark limits groups before it shuffles them)."""
    w = Window.partitionBy("v").orderBy("id")
    return refs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k + 1).drop("__n")


def knn_join(queries: DataFrame, refs: DataFrame, qid: str, rid: str, feats: Sequence[str], k: int,
             exclude_self: bool = False, block_rows: int | None = None, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """For every query id its k nearest reference ids: (qid, rid, dist, rank 1..k).

    Ties on distance are broken by the reference id.
    """
    q, r = _points(queries, qid, feats), _points(refs, rid, feats)
    block_rows = block_rows or max(1024, min(KNN_ROWS, KNN_VALUES // max(1, len(feats))))
    n_pivots = min(max_pivots, math.ceil(r.count() / block_rows))
    cand, _ = knn_candidates(q, r, k, exclude_self, block_rows, n_pivots)
    return _best(cand, k).select(F.col("q").alias(qid), F.col("r").alias(f"nbr_{rid}" if qid == rid else rid), "dist", "rank")


def knn_regress(train: DataFrame, test: DataFrame, id_col: str, feats: Sequence[str], target: str,
                k: int = 5, weights: str = "uniform") -> DataFrame:
    """Mean (or 1/d-weighted mean) of the k nearest training targets."""
    nb = knn_join(test, train, id_col, id_col, feats, k)
    tgt = train.select(col(id_col).alias(f"nbr_{id_col}"), to_double(target).alias("__t"))
    j = nb.join(tgt, f"nbr_{id_col}")
    if weights == "distance":
        zero = F.max(F.when(F.col("dist") == 0, 1).otherwise(0))
        wexpr = F.when(F.col("dist") == 0, 1.0).otherwise(1.0 / F.col("dist"))
        pred = F.when(zero == 1, F.avg(F.when(F.col("dist") == 0, F.col("__t")))) \
                .otherwise(F.sum(wexpr * F.col("__t")) / F.sum(wexpr))
    else:
        pred = F.avg("__t")
    return j.groupBy(id_col).agg(pred.alias("prediction"))


def knn_classify(train: DataFrame, test: DataFrame, id_col: str, feats: Sequence[str], label: str,
                 k: int = 5) -> DataFrame:
    """Majority vote of the k nearest labels; ties -> smallest label."""
    nb = knn_join(test, train, id_col, id_col, feats, k)
    lab = train.select(col(id_col).alias(f"nbr_{id_col}"), col(label).alias("__l"))
    votes = nb.join(lab, f"nbr_{id_col}").groupBy(id_col, "__l").agg(F.count(F.lit(1)).alias("__v"))
    w = Window.partitionBy(id_col).orderBy(F.desc("__v"), F.asc("__l"))
    return (votes.withColumn("__p", F.row_number().over(w)).where(F.col("__p") == 1)
            .select(id_col, F.col("__l").alias("prediction")))


def radius_regress(train: DataFrame, test: DataFrame, id_col: str, feats: Sequence[str], target: str,
                   radius: float = 1.0) -> DataFrame:
    """Mean target of training points within ``radius``; none -> NULL."""
    q = _points(test, id_col, feats)
    r = _points(train.where(to_double(target).isNotNull()), id_col, feats, to_double(target).alias("t"))

    def sums(qdf, rdf, near):
        return pd.DataFrame({"id": qdf["id"], "n": near.sum(axis=1), "s": np.where(near, rdf["t"].to_numpy(float), 0.0).sum(axis=1)})
    means = (radius_tiles(q, r, len(feats), radius, sums, "id long, n long, s double").where("n > 0")
             .groupBy(F.col("id").alias(id_col)).agg((F.sum("s") / F.sum("n")).alias("prediction")))
    return test.select(id_col).join(means, id_col, "left")


def sq_dist_expr(vec: Column, center: Sequence[float]) -> Column:
    """Squared Euclidean distance of an array column to a literal point,
    summed left to right with array higher-order functions (compact plan
    whatever the dimension)."""
    c = F.array(*[F.lit(float(v)) for v in center])
    diffs = F.zip_with(vec, c, lambda a, b: (a - b) * (a - b))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


def nearest_center(df: DataFrame, feats: Sequence[str], centers: Sequence[Sequence[float]],
                   out_col: str = "cluster") -> DataFrame:
    """Arg-min squared distance to k constant centers (k bounded by the model);
    ties -> lowest center index. Batches of rows meet all centers, a feature at a time;
    a distance that isn't a number is the largest."""
    points = [list(c) for c in centers]

    @F.pandas_udf("int")
    def nearest(*cols: pd.Series) -> pd.Series:
        X, C = np.column_stack([c.to_numpy(float) for c in cols]), np.array(points, float)
        out = np.zeros(len(X), np.int32)
        step = max(1, 200_000 // max(1, len(C)))
        for a in range(0, len(X), step):
            part = X[a:a + step]
            D = np.zeros((len(part), len(C)))
            with np.errstate(invalid="ignore", over="ignore"):
                for j in range(C.shape[1]):
                    d = part[:, j, None] - C[None, :, j]
                    d *= d
                    D += d
            bad = np.isnan(D)
            best = np.where(bad, np.inf, D).argmin(axis=1)
            if bad.any():
                best = np.where(np.take_along_axis(bad, best[:, None], 1)[:, 0], (~bad).argmax(axis=1), best)
            out[a:a + step] = best
        return pd.Series(out)
    xs = [to_double(f) for f in feats]
    return df.withColumn(out_col, F.when(all_true([x.isNotNull() for x in xs]), nearest(*xs)))


def _forest(near: np.ndarray, q_node: np.ndarray, r_node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node) that connect what the pairs of a tile connect: at most
    one for each node."""
    nodes, at = np.unique(np.concatenate((q_node, r_node)), return_inverse=True)
    qi, ri = at[:len(q_node)], at[len(q_node):]
    lab = np.arange(len(nodes), dtype=np.int32)
    none = np.int32(len(nodes))
    while True:
        new, by_r = lab.copy(), lab[ri]
        low = np.full(len(ri), none)
        for a in range(0, len(qi), 256):
            part = near[a:a + 256]
            low = np.minimum(low, np.where(part, lab[qi[a:a + 256]][:, None], none).min(axis=0))
            np.minimum.at(new, qi[a:a + 256], np.where(part, by_r[None, :], none).min(axis=1))
        np.minimum.at(new, ri, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    move = np.flatnonzero(lab != np.arange(len(nodes)))
    return nodes[move], nodes[lab[move]]


def connect(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, lab): the least node of each node's component; ``edges`` (u, v), ``nodes``
    (id). Rounds of least neighbour and pointer jumping, each cut by a checkpoint."""
    both = cut_lineage(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(nodes.select("id", F.col("id").alias("lab")))
    while True:  # until no label changes
        least = (both.join(labels.withColumnRenamed("id", "v"), "v")
                 .groupBy(F.col("u").alias("id")).agg(F.min("lab").alias("cand")))
        # hook, then materialise: the shortcut below reads the result twice,
        # so without a cut the plan would double every round
        hooked = cut_lineage(labels.join(least, "id", "left").select("id", F.least("lab", F.coalesce("cand", "lab")).alias("lab")))
        jump = hooked.select(F.col("id").alias("lab"), F.col("lab").alias("lab2"))
        new = cut_lineage(hooked.join(jump, "lab", "left").select("id", F.least("lab", F.coalesce("lab2", "lab")).alias("lab")))
        changed = new.join(labels.withColumnRenamed("lab", "old"), "id").where(F.col("lab") != F.col("old")).isEmpty()
        labels = new
        if changed:
            return labels


def dbscan(df: DataFrame, id_col: str, feats: Sequence[str], eps: float = 0.5, min_samples: int = 5,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Density clustering.

    Tiles of the radius join count neighbours (self included): core points have at
    least min_samples. Core points of one fine cell (diagonal eps) are all neighbours
    and so one node. A second join of the core points returns for each tile the edges
    of a spanning forest between nodes, at most one a node, so no list of pairs is
    kept however dense the points lie; components of the forests are the clusters.
    Cluster id = smallest core id; a border point takes the smallest cluster id among
    its core neighbours (a third join, minima only); others are noise (-1).
    """
    p = len(feats)
    pts = cut_lineage(_points(df, id_col, feats))
    grid = _grid(pts, p, eps)

    def count(qdf, rdf, near):
        return pd.DataFrame({"id": qdf["id"], "n": near.sum(axis=1)})
    deg = radius_tiles(pts, pts, p, eps, count, "id long, n long", block_rows, grid).groupBy("id").agg(F.sum("n").alias("n"))
    marked = cut_lineage(pts.join(deg, "id").select("id", "v", (F.col("n") >= min_samples).alias("core")))
    # a hair smaller than eps, so that rounding can't make the diagonal longer
    side = max(eps / math.sqrt(max(p, 1)) * (1 - 1e-9), 1e-300)
    fine = marked.where("core").withColumn("cell", F.transform("v", lambda x: F.floor(x / F.lit(side))))
    names = fine.groupBy("cell").agg(F.min("id").alias("node"))
    core = cut_lineage(fine.join(names, "cell").select("id", "v", "node"))

    def link(qdf, rdf, near):
        u, v = _forest(near, qdf["node"].to_numpy(), rdf["node"].to_numpy())
        return pd.DataFrame({"u": u, "v": v})
    edges = radius_tiles(core, core, p, eps, link, "u long, v long", block_rows, grid).distinct()
    labels = connect(edges, core.select(F.col("node").alias("id")).distinct())
    core = core.join(labels.withColumnRenamed("id", "node"), "node").select("id", "v", "lab")
    core = cut_lineage(core)

    def least(qdf, rdf, near):
        lab = np.where(near, rdf["lab"].to_numpy()[None, :], np.iinfo(np.int64).max).min(axis=1)
        keep = near.any(axis=1)
        return pd.DataFrame({"id": qdf["id"].to_numpy()[keep], "blab": lab[keep]})
    border = (radius_tiles(marked.where("NOT core").drop("core"), core, p, eps, least, "id long, blab long", block_rows, grid)
              .groupBy("id").agg(F.min("blab").alias("blab")))
    return cut_lineage(
        df.select(col(id_col).cast("long").alias("id")).join(core.select("id", "lab"), "id", "left").join(border, "id", "left")
        .select(F.col("id").alias(id_col), F.coalesce("lab", "blab", F.lit(-1)).cast("long").alias("cluster")))


def local_outlier_factor(df: DataFrame, id_col: str, feats: Sequence[str], k: int = 20,
                         contamination: float = 0.1) -> DataFrame:
    """LOF over the training rows (self excluded from its neighbours).

    kNN join -> k-distance per point -> reachability -> local density (lrd)
    -> LOF; outliers are the lowest ``contamination`` share of -LOF, with the
    threshold taken as the linear-interpolated percentile.
    """
    nb = knn_join(df, df, id_col, id_col, feats, k, exclude_self=True).persist(StorageLevel.MEMORY_AND_DISK)
    nid = f"nbr_{id_col}"
    kdist = nb.where(F.col("rank") == k).select(F.col(id_col).alias(nid), F.col("dist").alias("kd"))
    reach = nb.join(kdist, nid).withColumn("rd", F.greatest("dist", "kd"))
    lrd = reach.groupBy(id_col).agg((1.0 / (F.avg("rd") + 1e-10)).alias("lrd"))
    lof = (nb.join(lrd.select(F.col(id_col).alias(nid), F.col("lrd").alias("lrd_o")), nid)
           .groupBy(id_col).agg(F.avg("lrd_o").alias("m")).join(lrd, id_col)
           .select(id_col, (F.col("m") / F.col("lrd")).alias("lof")))
    lof = cut_lineage(lof)
    nb.unpersist()
    thr = quantile(lof, -F.col("lof"), contamination)
    return lof.withColumn("inlier", (-F.col("lof")) >= F.lit(thr))
