"""Isolation forest outlier detection (O3), contamination 0.1, seed 42.

* Sampling: each row joins the sample of tree t when a seeded hash of
  (t, key) falls under ~2x the wanted rate (a higher-order ``filter`` over
  tree ids, so no pass per tree); each tree keeps the 256 smallest hashes.
* Building: ``groupBy(tree).applyInPandas`` grows one isolation tree per
  group (<= a few hundred rows each) with random feature / split choices.
* Scoring: the trees (100 x <= 511 nodes: bounded) ship to an Arrow-batched
  pandas UDF computing the mean path length; score = 2^(-E(h) / c(256)).
* Threshold: rows whose score is in the top ``contamination`` share of the
  training scores are outliers (percentile of the training scores).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.exprs import col, to_double
from quarry.functions.quantiles import quantile

EULER = 0.5772156649015329


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(X: np.ndarray, rng: np.random.Generator, max_depth: int):
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        i = len(feat)
        feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1); size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return i
        sub = X[idx]
        lo, hi = sub.min(0), sub.max(0)
        cand = np.nonzero(hi > lo)[0]
        if len(cand) == 0:
            return i
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[i], thr[i] = f, t
        mask = sub[:, f] < t
        li = node(idx[mask], depth + 1)
        ri = node(idx[~mask], depth + 1)
        left[i], right[i] = li, ri
        return i

    node(np.arange(len(X)), 0)
    return np.array(feat), np.array(thr), np.array(left), np.array(right), np.array(size, float)


def _path_lengths(X: np.ndarray, tree) -> np.ndarray:
    """Path length of every row: all rows step down together, a leaf leads to itself."""
    feat, thr, left, right, size = (np.asarray(a) for a in tree)
    n, leaf = len(X), feat < 0
    here = np.arange(len(feat))
    column = np.where(leaf, 0, feat) * n
    kids = np.column_stack((np.where(leaf, here, right), np.where(leaf, here, left))).ravel()
    depth = np.zeros(len(feat))
    for i in here[~leaf]:  # children follow their parent
        depth[[left[i], right[i]]] = depth[i] + 1
    length = depth + np.array([c_factor(s) for s in size])
    values, rows = np.ascontiguousarray(X.T).ravel(), np.arange(n)
    node = np.zeros(n, np.int64)
    for _ in range(int(depth.max())):
        node = kids.take(2 * node + (values.take(column.take(node) + rows) < thr.take(node)))
    return length.take(node)


@dataclass
class IsolationForestModel:
    features: list
    trees: list
    sample_size: int
    offset: float | None = None  # threshold on -score (reference convention)

    def score_expr(self) -> Column:
        trees, n = self.trees, self.sample_size
        cn = c_factor(n)

        @F.pandas_udf("double")
        def score(*cols: pd.Series) -> pd.Series:
            X = np.column_stack([c.to_numpy(float) for c in cols])
            h = sum(_path_lengths(X, t) for t in trees) / len(trees)
            return pd.Series(2.0 ** (-h / cn))

        return score(*[to_double(f) for f in self.features])

    def transform(self, df: DataFrame, out_col: str = "inlier") -> DataFrame:
        out = df.withColumn("if_score", self.score_expr())
        return out.withColumn(out_col, (-F.col("if_score")) >= F.lit(self.offset))


def fit_isolation_forest(df: DataFrame, features: Sequence[str], key_cols: Sequence[str], n_trees: int = 100,
                         sample_size: int = 256, contamination: float = 0.1, seed: int = 42) -> IsolationForestModel:
    feats = list(features)
    n = df.count()
    psi = int(min(sample_size, n))
    rate = min(1.0, 2.0 * psi / max(n, 1))
    scale = 1_000_000_007
    thr = int(rate * scale)
    keys = [col(k) for k in key_cols]
    trees_for_row = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                             lambda t: F.pmod(F.xxhash64(F.lit(seed), t, *keys), F.lit(scale)) < F.lit(thr))
    sampled = (df.select(*[to_double(f).alias(f"f{i}") for i, f in enumerate(feats)],
                         F.xxhash64(F.lit(seed + 1), *keys).alias("__h"),
                         F.explode(trees_for_row).alias("tree")))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("__h").head(psi)
        X = pdf[[f"f{i}" for i in range(len(feats))]].to_numpy(float)
        rng = np.random.default_rng([seed, t])
        feat, th, le, ri, size = _grow(X, rng, max_depth)
        return pd.DataFrame({"tree": [t], "feat": [feat.tolist()], "thr": [th.tolist()], "left": [le.tolist()],
                             "right": [ri.tolist()], "size": [size.tolist()]})

    rows = (sampled.groupBy("tree").applyInPandas(
        build, "tree int, feat array<long>, thr array<double>, left array<long>, right array<long>, size array<double>")
        .collect())  # n_trees small trees
    trees = [(np.array(r["feat"]), np.array(r["thr"]), np.array(r["left"]), np.array(r["right"]),
              np.array(r["size"])) for r in sorted(rows, key=lambda r: r["tree"])]
    model = IsolationForestModel(feats, trees, psi)
    scored = df.select((-model.score_expr()).alias("s")).persist(StorageLevel.MEMORY_AND_DISK)  # the quantile reads them several times
    model.offset = quantile(scored, F.col("s"), contamination)
    scored.unpersist()
    return model
