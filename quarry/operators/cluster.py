"""Clustering.

Spark ML estimators run as they are where they exist (k-means, bisecting
k-means, Gaussian mixture, power iteration). Hierarchical methods that need
all pairwise merges are re-aimed: Spark k-means first reduces the data to at
most ``micro`` weighted micro-clusters (bounded, independent of row count),
the merge tree is built on those on the driver, and every row is then
labelled with a broadcast nearest-center expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from quarry.functions.exprs import col, to_double
from quarry.operators import neighbors
from quarry.operators.metrics import cluster_scores, silhouette_squared
from quarry.operators.neighbors import nearest_center
from quarry.operators.trees import grouped
from quarry.session import cut_lineage


@dataclass
class ClusterModel:
    features: list
    centers: list | None  # None: the method cannot label new points (U11)
    kind: str

    def transform(self, df: DataFrame, out_col: str = "cluster") -> DataFrame:
        if self.centers is None:
            raise ValueError(f"{self.kind} cannot assign new points; refit on the new data instead")
        return nearest_center(df, self.features, self.centers, out_col)


def _vec(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(feats), outputCol="__x", handleInvalid="skip").transform(
        df.select("*", *[to_double(f).alias(f"__d{i}") for i, f in enumerate(feats)]).drop(*feats)
        .withColumnsRenamed({f"__d{i}": f for i, f in enumerate(feats)}))


def kmeans(df: DataFrame, feats: Sequence[str], k: int = 8, seed: int = 42, max_iter: int = 300,
           weight_col: str | None = None) -> ClusterModel:
    """K-means (k-means|| initialisation)."""
    from pyspark.ml.clustering import KMeans
    km = KMeans(featuresCol="__x", k=k, seed=seed, maxIter=max_iter, tol=1e-4)
    if weight_col:
        km = km.setWeightCol(weight_col)
    m = km.fit(_vec(df, feats))
    return ClusterModel(list(feats), [c.tolist() for c in m.clusterCenters()], "kmeans")


def bisecting_kmeans(df: DataFrame, feats: Sequence[str], k: int = 8, seed: int = 42) -> ClusterModel:
    """U3."""
    from pyspark.ml.clustering import BisectingKMeans
    m = BisectingKMeans(featuresCol="__x", k=k, seed=seed).fit(_vec(df, feats))
    return ClusterModel(list(feats), [c.tolist() for c in m.clusterCenters()], "bisecting_kmeans")


def gaussian_mixture(df: DataFrame, feats: Sequence[str], k: int = 8, seed: int = 42):
    """U4: full-covariance mixture; labels = most probable component."""
    from pyspark.ml.clustering import GaussianMixture
    m = GaussianMixture(featuresCol="__x", k=k, seed=seed, predictionCol="cluster").fit(_vec(df, feats))
    return m


def minibatch_kmeans(df: DataFrame, feats: Sequence[str], k: int = 8, seed: int = 42, batch_fraction: float = 0.1,
                     steps: int = 50) -> ClusterModel:
    """Each step draws a seeded sample, assigns it to the current centers
    (broadcast expression) and moves centers by the per-center running count."""
    init = kmeans(df.sample(fraction=min(1.0, batch_fraction), seed=seed), feats, k, seed, max_iter=5).centers
    C = np.array(init, float)
    counts = np.zeros(len(C))
    for s in range(steps):
        batch = nearest_center(df.sample(fraction=batch_fraction, seed=seed + s + 1), feats, C.tolist(), "__c")
        rows = batch.groupBy("__c").agg(F.count(F.lit(1)).alias("n"),
                                         *[F.avg(to_double(f)).alias(f"m{i}") for i, f in enumerate(feats)]).collect()
        for r in rows:  # at most k rows
            c, n = r["__c"], r["n"]
            counts[c] += n
            eta = n / counts[c]
            C[c] = (1 - eta) * C[c] + eta * np.array([r[f"m{i}"] for i in range(len(feats))])
    return ClusterModel(list(feats), C.tolist(), "minibatch_kmeans")


def _ward_merge(centers: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Ward agglomeration of weighted points down to k groups; returns labels. Only
    the merged row of the cost table is computed anew."""
    cen, w = centers.astype(float).copy(), weights.astype(float).copy()
    n = len(cen)
    owner = np.arange(n)

    def costs(i):
        return w[i] * w / (w[i] + w) * ((cen - cen[i]) ** 2).sum(axis=1)

    cost = np.array([costs(i) for i in range(n)])
    np.fill_diagonal(cost, np.inf)
    for _ in range(n - k):
        a, b = sorted(np.unravel_index(np.argmin(cost), cost.shape))
        cen[a] = (w[a] * cen[a] + w[b] * cen[b]) / (w[a] + w[b])
        w[a] += w[b]
        owner[owner == b] = a
        gone = np.isinf(cost[a]) & (np.arange(n) != a)
        row = costs(a)
        row[gone] = np.inf
        row[[a, b]] = np.inf
        cost[a, :] = cost[:, a] = row
        cost[b, :] = cost[:, b] = np.inf
    return np.unique(owner, return_inverse=True)[1]


def _merged(points: DataFrame, feats: Sequence[str], k: int, micro: int, seed: int, kind: str,
            weight_col: str | None = None) -> ClusterModel:
    """Ward merge of at most ``max(micro, k)`` weighted k-means micro-clusters of the
    points; fewer distinct points are their own micro-clusters."""
    km = kmeans(points, feats, max(micro, k), seed, max_iter=20, weight_col=weight_col)
    lab = nearest_center(points, feats, km.centers, "__m")
    weight = F.sum(weight_col) if weight_col else F.count(F.lit(1))
    w = {r["__m"]: r["n"] for r in lab.groupBy("__m").agg(weight.alias("n")).collect()}
    cen = np.array(km.centers, float)
    weights = np.array([w.get(i, 0) for i in range(len(cen))], float)
    keep = weights > 0
    cen, weights = cen[keep], weights[keep]
    labels = _ward_merge(cen, weights, min(k, len(cen)))
    merged = [((cen[labels == g] * weights[labels == g, None]).sum(0) / weights[labels == g].sum()).tolist()
              for g in range(labels.max() + 1)]
    return ClusterModel(list(feats), merged, kind)


def agglomerative(df: DataFrame, feats: Sequence[str], k: int = 8, micro: int = 500, seed: int = 42) -> ClusterModel:
    """U5 (ward), re-aimed: k-means micro-clusters, ward merge on their weighted
    centers, rows labelled by nearest merged center."""
    return _merged(df, feats, k, micro, seed, "agglomerative")


def birch(df: DataFrame, feats: Sequence[str], k: int = 8, threshold: float = 0.5, micro: int = 500, seed: int = 42) -> ClusterModel:
    """Clustering features (n, mean x) per threshold-sized grid cell from one
    groupBy; the cells are reduced and ward-merged like the points of U5, by weight,
    whatever their number."""
    cell = [F.floor(to_double(f) / F.lit(threshold)).cast("long").alias(f"__g{i}") for i, f in enumerate(feats)]
    cf = (df.select(*cell, *[to_double(f).alias(f"__v{i}") for i, f in enumerate(feats)])
          .groupBy(*[f"__g{i}" for i in range(len(feats))])
          .agg(F.count(F.lit(1)).cast("double").alias("__n"), *[F.avg(f"__v{i}").alias(f) for i, f in enumerate(feats)])
          .drop(*[f"__g{i}" for i in range(len(feats))]))
    return _merged(cf, feats, k, micro, seed, "birch", "__n")


def mean_shift(df: DataFrame, feats: Sequence[str], bandwidth: float | None = None, min_bin_freq: int = 1,
               max_iter: int = 30) -> ClusterModel:
    """Bin seeding: every bandwidth-sized cell of at least ``min_bin_freq`` rows is
    a seed. Seeds are a table; each step moves them to the mean of the rows within the
    bandwidth by a radius join that returns sums. Settled seeds closer than the
    bandwidth merge, the one with most rows first, in rounds of a join of the seeds
    with themselves. Only the final centers reach the driver."""
    p = len(feats)
    if bandwidth is None:
        sd = df.agg(*[F.stddev_pop(to_double(f)).alias(f"s{i}") for i, f in enumerate(feats)]).first()
        bandwidth = float(np.mean([sd[f"s{i}"] or 1.0 for i in range(p)]))
    rows = cut_lineage(neighbors._points(df.withColumn("__rid", F.monotonically_increasing_id()), "__rid", feats))
    cell = F.transform("v", lambda x: F.floor(x / F.lit(bandwidth)))
    seeds = (rows.groupBy(cell.alias("g")).count().where(F.col("count") >= min_bin_freq)
             .select(F.monotonically_increasing_id().alias("id"), F.transform("g", lambda g: (g + 0.5) * F.lit(bandwidth)).alias("v"),
                     F.lit(0).cast("long").alias("n"), F.lit(True).alias("moving")))
    seeds = cut_lineage(seeds)
    if seeds.isEmpty():
        raise ValueError(f"no cell of the bandwidth {bandwidth} has {min_bin_freq} rows")
    grid = neighbors._grid(rows, p, bandwidth)

    def sums(qdf, rdf, near):
        keep = near.any(axis=1)
        total = near[keep].astype(float) @ neighbors._matrix(rdf["v"])
        return pd.DataFrame({"id": qdf["id"].to_numpy()[keep], "n": near[keep].sum(axis=1), "s": pd.Series(list(total), dtype=object)})
    for _ in range(max_iter):
        parts = neighbors.radius_tiles(seeds.where("moving").select("id", "v"), rows, p, bandwidth, sums, "id long, n long, s array<double>", grid=grid)
        means = parts.groupBy("id").agg(F.sum("n").alias("n2"), F.array(*[F.sum(F.col("s")[i]) for i in range(p)]).alias("s"))
        apart = F.array_max(F.zip_with("v", "v2", lambda a, b: F.abs(a - b)))
        seeds = cut_lineage(
            seeds.join(means, "id", "left").withColumn("v2", F.transform("s", lambda x: x / F.col("n2")))
            .select("id", F.coalesce("v2", "v").alias("v"), F.coalesce("n2", "n").alias("n"),
                    (F.col("moving") & F.coalesce(apart >= 1e-3 * bandwidth, F.lit(False))).alias("moving")))
        if seeds.where("moving").isEmpty():
            break

    def beaten(qdf, rdf, near):
        # more rows win, then the smaller id
        n, m = qdf["n"].to_numpy()[:, None], rdf["n"].to_numpy()[None, :]
        i, j = qdf["id"].to_numpy()[:, None], rdf["id"].to_numpy()[None, :]
        return pd.DataFrame({"id": qdf["id"], "lost": (near & ((m > n) | ((m == n) & (j < i)))).any(axis=1)})

    def close(qdf, rdf, near):
        return pd.DataFrame({"id": qdf["id"].to_numpy()[near.any(axis=1)]})
    left, centers = seeds.select("id", "v", "n"), []
    while not left.isEmpty():
        lost = (neighbors.radius_tiles(left, left, p, bandwidth, beaten, "id long, lost boolean", grid=grid)
                .groupBy("id").agg(F.max("lost").alias("lost")))
        won = cut_lineage(left.join(lost.where("NOT lost").select("id"), "id"))
        centers += [(r["n"], r["v"]) for r in won.collect()]
        gone = neighbors.radius_tiles(left, won, p, bandwidth, close, "id long", grid=grid).distinct()
        left = cut_lineage(left.join(gone, "id", "left_anti"))
    centers.sort(key=lambda c: (-c[0], c[1]))
    return ClusterModel(list(feats), [c[1] for c in centers], "meanshift")


def _gram(table: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Products of all pairs of columns, summed over the rows."""
    def add(part, out):
        out += part.T @ part
    return grouped(table.select(*cols), len(cols), len(cols), add, "sum")


def _combined(table: DataFrame, cols: Sequence[str], M: np.ndarray, names: Sequence[str]) -> DataFrame:
    """(id, names...): the columns times a matrix."""
    def run(batches):
        for batch in batches:
            X = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols])
            Y = X @ M
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(Y[:, j]) for j in range(len(names))]], ["id", *names])
    return table.select("id", *cols).mapInArrow(run, "id long, " + ", ".join(f"{n} double" for n in names))


def leading_vectors(edges: DataFrame, start: DataFrame, first: str, k: int, blocks: int = 10, restarts: int = 6,
                    tol: float = 1e-4, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(id, u0..): the ``k`` leading eigenvectors of a symmetric matrix (src, dst, w), and
    their values. A block of k + 2 vectors is multiplied by the matrix (an edge join
    and a grouped sum), made orthogonal to all before it from one pass of products, and
    added to the basis; after ``blocks`` blocks the best vectors of the basis start anew,
    until the products leave less than ``tol`` outside."""
    b = k + 2

    def orthonormal(gram: np.ndarray) -> np.ndarray:
        """Combinations of columns of this Gram matrix that are orthonormal."""
        vals, vecs = np.linalg.eigh((gram + gram.T) / 2)
        keep = vals > 1e-12 * max(vals.max(), 1e-300)
        return vecs[:, keep] / np.sqrt(vals[keep])
    noise = [(F.xxhash64("id", F.lit(seed), F.lit(j)) / F.lit(2.0 ** 63)).alias(f"s{j}") for j in range(1, b)]
    block = cut_lineage(start.select("id", col(first).cast("double").alias("s0"), *noise))
    names = block.columns[1:]
    values = np.zeros(k)
    for _ in range(restarts):
        M = orthonormal(_gram(block, names))
        basis = [f"q{j}" for j in range(M.shape[1])]
        table = cut_lineage(_combined(block, names, M, basis))
        newest, H = list(basis), np.zeros((0, 0))
        for step in range(blocks):
            raw = [f"r{j}" for j in range(len(newest))]
            moved = (edges.join(table.select(F.col("id").alias("dst"), *newest), "dst").groupBy(F.col("src").alias("id"))
                     .agg(*[F.sum(F.col("w") * F.col(c)).alias(r) for c, r in zip(newest, raw)]))
            table = cut_lineage(table.join(moved, "id", "left").na.fill(0.0, raw))
            G = _gram(table, [*basis, *raw])
            n, first_new = len(basis), len(basis) - len(newest)
            P = G[:n, n:]  # basis times matrix times newest
            grown = np.zeros((n, n))
            grown[:len(H), :len(H)] = H
            grown[:, first_new:] = P
            grown[first_new:, :] = P.T
            H = (grown + grown.T) / 2
            rest = G[n:, n:] - P.T @ P
            if step + 1 == blocks or np.trace(rest) < 1e-14 * np.trace(G[n:, n:]):
                break
            M = orthonormal(rest)
            fresh = [f"q{n + j}" for j in range(M.shape[1])]
            lift = np.zeros((n + len(raw), n + len(fresh)))
            lift[:n, :n] = np.eye(n)
            lift[:n, n:], lift[n:, n:] = -P @ M, M
            table = cut_lineage(_combined(table, [*basis, *raw], lift, [*basis, *fresh]))
            newest, basis = fresh, [*basis, *fresh]
        vals, vecs = np.linalg.eigh(H)
        best = np.argsort(vals)[::-1][:b]
        names = [f"u{j}" for j in range(len(best))]
        block = cut_lineage(_combined(table, basis, vecs[:, best], names))
        values, top = vals[best], vecs[len(basis) - len(newest):, best[:k]]
        # what the newest block sends outside the basis bounds the error of each vector
        if np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", top, rest, top), 0)).max(initial=0.0) < tol:
            break
    return block.select("id", *names[:k]), values[:k]


def spectral(df: DataFrame, id_col: str, feats: Sequence[str], k: int = 8, n_neighbors: int = 10,
             seed: int = 42) -> DataFrame:
    """U8: k-means on the k leading vectors of the normalised graph of nearest
    neighbours (kNN join, so edges grow linearly with rows). Cannot label new points."""
    nb = neighbors.knn_join(df, df, id_col, id_col, feats, n_neighbors, exclude_self=True)
    nb = cut_lineage(nb.select(col(id_col).cast("long").alias("src"), col(f"nbr_{id_col}").cast("long").alias("dst"), "dist"))
    sigma = nb.agg(F.avg("dist")).first()[0] or 1.0
    w = F.exp(-(F.col("dist") ** 2) / F.lit(2 * sigma ** 2)) / 2
    both = nb.select("src", "dst", w.alias("w")).union(nb.select(F.col("dst").alias("src"), F.col("src").alias("dst"), w.alias("w")))
    edges = cut_lineage(both.groupBy("src", "dst").agg(F.sum("w").alias("w")).where("w > 0"))
    root = cut_lineage(edges.groupBy(F.col("src").alias("id")).agg(F.sqrt(F.sum("w")).alias("root")))
    edges = cut_lineage(edges.join(root.select(F.col("id").alias("src"), F.col("root").alias("a")), "src")
                        .join(root.select(F.col("id").alias("dst"), F.col("root").alias("b")), "dst")
                        .select("src", "dst", (F.col("w") / (F.col("a") * F.col("b"))).alias("w")))
    vectors, _ = leading_vectors(edges, root, "root", k, seed=seed)
    names = [c for c in vectors.columns if c != "id"]
    places = cut_lineage(vectors.join(root, "id").select("id", *[(F.col(c) / F.col("root")).alias(c) for c in names]))
    return kmeans(places, names, k, seed).transform(places, "cluster").select(F.col("id").alias(id_col), F.col("cluster").cast("long"))


def scan_k(df: DataFrame, feats: Sequence[str], ks: Sequence[int] = range(2, 9), method: str = "kmeans",
           seed: int = 42) -> DataFrame:
    """Fit for each k and score (silhouette on squared distances, CH, DB);
    one row per k. The best k is the row with the highest silhouette_sq."""
    rows = []
    for k in ks:
        fn = {"kmeans": kmeans, "bisecting_kmeans": bisecting_kmeans}.get(method, kmeans)
        m = fn(df, feats, k, seed)
        lab = m.transform(df, "cluster_k").persist(StorageLevel.MEMORY_AND_DISK)  # the scores read it four times
        s = silhouette_squared(lab, feats, "cluster_k").first()[0]
        cs = cluster_scores(lab, feats, "cluster_k").first()
        lab.unpersist()
        rows.append((int(k), s, cs["calinski_harabasz"], cs["davies_bouldin"]))
    return df.sparkSession.createDataFrame(
        rows, "k int, silhouette_sq double, calinski_harabasz double, davies_bouldin double")
