"""Reweighted, trial-based and boosted models (I and B families); gradient-trained
ones are in ``gradient``.

* Quantile regression: iteratively reweighted Gram solves (one weighted
  moments pass per iteration).
* Theil-Sen / RANSAC: hypotheses from a bounded seeded sample of rows, then
  one pass over all rows scores every hypothesis; the winner is refit on its
  inliers by a Gram solve.
* AdaBoost: a driver loop of weighted Spark tree fits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.exprs import col, key_hash, to_double
from quarry.operators.linear import LinearModel, Moments, coordinate_descent, solve
from quarry.operators.native import class_list, decision_tree

# ------------------------------------------------------------------ quantile regression

def weighted_moments(df: DataFrame, cols: Sequence[str], w: Column) -> Moments:
    xs = [to_double(c) for c in cols]
    k = len(xs)
    aggs = [F.sum(w).alias("sw")] + [F.sum(w * x).alias(f"s{i}") for i, x in enumerate(xs)]
    aggs += [F.sum(w * xs[i] * xs[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    r = df.agg(*aggs).first()
    n = r["sw"]
    mean = np.array([r[f"s{i}"] / n for i in range(k)])
    C = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            C[i, j] = C[j, i] = r[f"c{i}_{j}"] - n * mean[i] * mean[j]
    return Moments(n, mean, C)


def quantile_regression(df: DataFrame, features: Sequence[str], target: str, q: float = 0.5,
                        alpha: float = 1.0, iters: int = 20, delta: float = 1e-6) -> LinearModel:
    """Pinball loss by IRLS; weights |r|^-1 scaled by q / (1-q) by sign.
    The L1 penalty ``alpha`` is applied by coordinate descent on each
    weighted Gram (objective per unit weight)."""
    feats = list(features)
    data = df.select(*[to_double(f).alias(f) for f in feats], to_double(target).alias("__y")).na.drop()
    coef, b = np.zeros(len(feats)), 0.0
    n = data.count()
    for _ in range(iters):
        pred = F.lit(float(b))
        for f, w_ in zip(feats, coef):
            pred = pred + F.lit(float(w_)) * F.col(f)
        r = F.col("__y") - pred
        w = F.when(r >= 0, F.lit(q)).otherwise(F.lit(1 - q)) / F.greatest(F.abs(r), F.lit(delta))
        mo = weighted_moments(data, feats + ["__y"], w)
        p = len(feats)
        G, c = mo.C[:p, :p], mo.C[:p, p]
        # sum_i w_i r_i^2 = sum_i rho_q(r_i); halving both terms of
        # (1/n) sum rho + alpha |w|_1 gives the Gram objective with l1 = n * alpha / 2
        new = (coordinate_descent(G, c, float(n), alpha / 2.0, 1.0) if alpha
               else np.linalg.lstsq(G, c, rcond=None)[0])
        nb = float(mo.mean[p] - new @ mo.mean[:p])
        done = np.max(np.abs(new - coef)) < 1e-8 and abs(nb - b) < 1e-8
        coef, b = new, nb
        if done:
            break
    return LinearModel(feats, coef, b, target)


# ------------------------------------------------------------------ trial-based robust regression

def _pool(df: DataFrame, feats: Sequence[str], target: str, key_cols: Sequence[str], size: int, seed: int):
    """Bounded seeded sample (the ``size`` smallest row hashes) for hypotheses."""
    h = key_hash(seed, list(key_cols))
    rows = (df.select(*[to_double(f).alias(f) for f in feats], to_double(target).alias("__y"), h.alias("__h"))
            .na.drop().orderBy("__h").limit(size).collect())
    X = np.array([[r[f] for f in feats] for r in rows], float)
    y = np.array([r["__y"] for r in rows], float)
    return X, y


def theil_sen(df: DataFrame, features: Sequence[str], target: str, key_cols: Sequence[str],
              n_trials: int = 1000, seed: int = 42) -> LinearModel:
    """Least squares on random (p+1)-row subsets, spatial median of solutions."""
    feats = list(features)
    p = len(feats)
    X, y = _pool(df, feats, target, key_cols, n_trials * (p + 1), seed)
    rng = np.random.default_rng(seed)
    sols = []
    A = np.column_stack([np.ones(len(X)), X])
    for _ in range(n_trials):
        idx = rng.choice(len(X), size=min(p + 1, len(X)), replace=False)
        sols.append(np.linalg.lstsq(A[idx], y[idx], rcond=None)[0])
    S = np.array(sols)
    med = S.mean(0)
    for _ in range(300):  # Weiszfeld spatial median
        d = np.linalg.norm(S - med, axis=1)
        d[d == 0] = 1e-12
        new = (S / d[:, None]).sum(0) / (1 / d).sum()
        if np.linalg.norm(new - med) < 1e-10:
            break
        med = new
    return LinearModel(feats, med[1:], float(med[0]), target)


def ransac(df: DataFrame, features: Sequence[str], target: str, key_cols: Sequence[str],
           n_trials: int = 100, seed: int = 42) -> LinearModel:
    """Hypotheses from minimal subsets of a seeded pool; ONE pass counts
    every hypothesis's inliers (|r| <= MAD of y); best refit by Gram."""
    from quarry.functions.quantiles import column_quantiles
    from quarry.operators.linear import moments
    feats = list(features)
    p = len(feats)
    X, y = _pool(df, feats, target, key_cols, n_trials * (p + 1), seed)
    med = column_quantiles(df, [target], [0.5])[target][0]
    mad = column_quantiles(df.select(F.abs(to_double(target) - F.lit(med)).alias("d")), ["d"], [0.5])["d"][0]
    rng = np.random.default_rng(seed)
    A = np.column_stack([np.ones(len(X)), X])
    hyps = []
    for _ in range(n_trials):
        idx = rng.choice(len(X), size=min(p + 1, len(X)), replace=False)
        hyps.append(np.linalg.lstsq(A[idx], y[idx], rcond=None)[0])

    def resid(h):
        e = to_double(target) - F.lit(float(h[0]))
        for f, w in zip(feats, h[1:]):
            e = e - F.lit(float(w)) * to_double(f)
        return F.abs(e)

    row = df.agg(*[F.count_if(resid(h) <= F.lit(float(mad))).alias(f"h{i}") for i, h in enumerate(hyps)]).first()
    best = max(range(n_trials), key=lambda i: (row[f"h{i}"], -i))
    inl = df.where(resid(hyps[best]) <= F.lit(float(mad)))
    mo = moments(inl, feats + [target])[None]
    coef, b, _ = solve(mo, p, "ols", False, False)
    return LinearModel(feats, coef, b, target, {"inliers": row[f"h{best}"]})


# ------------------------------------------------------------------ AdaBoost

@dataclass
class BoostModel:
    trees: list
    alphas: list
    task: str
    classes: list | None

    def transform(self, df: DataFrame, out_col: str = "prediction") -> DataFrame:
        out = df
        for i, t in enumerate(self.trees):
            out = t.transform(out).withColumnRenamed("prediction", f"__t{i}")
        cols = [F.col(f"__t{i}") for i in range(len(self.trees))]
        if self.task == "regression":
            # weighted median of the tree predictions (R2)
            w = np.array(self.alphas) / sum(self.alphas)
            arr = F.array(*[F.struct(c.alias("v"), F.lit(float(wi)).alias("w")) for c, wi in zip(cols, w)])
            s = F.array_sort(arr, lambda a, b: F.when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0))
            cum = F.transform(s, lambda x, i: F.aggregate(F.slice(s, 1, i + 1), F.lit(0.0), lambda acc, y: acc + y["w"]))
            idx = F.array_position(F.transform(cum, lambda c: c >= 0.5), True)
            pred = F.element_at(s, idx.cast("int"))["v"]
        else:
            score = {c: F.lit(0.0) for c in self.classes}
            for c_ in self.classes:
                for col_, a in zip(cols, self.alphas):
                    score[c_] = score[c_] + F.when(col_ == F.lit(c_), F.lit(float(a))).otherwise(0.0)
            arr = F.array(*[score[c] for c in self.classes])
            pred = F.element_at(F.array(*[F.lit(c) for c in self.classes]),
                                F.array_position(arr, F.array_max(arr)).cast("int"))
        return out.withColumn(out_col, pred).drop(*[f"__t{i}" for i in range(len(self.trees))])


def adaboost(df: DataFrame, features: Sequence[str], target: str, task: str = "regression",
             rounds: int = 50, depth: int | None = None, seed: int = 42) -> BoostModel:
    """R33 (AdaBoost.R2, linear loss) / C22 (SAMME) with Spark tree fits on a
    weight column; lineage is cut every few rounds."""
    from quarry.session import cut_lineage
    depth = depth or (3 if task == "regression" else 1)
    data = df.select(*[to_double(f).alias(f) for f in features], col(target).alias("__t")).na.drop()
    data = data.withColumn("__w", F.lit(1.0))
    classes = class_list(data, "__t") if task == "classification" else None
    K = len(classes) if classes else 0
    trees, alphas = [], []
    for r in range(rounds):
        tree = decision_tree(task, depth, seed + r).fit(data, features, "__t", weight_col="__w")
        pred = tree.transform(data)
        if task == "regression":
            err = F.abs(F.col("prediction") - to_double("__t"))
            mx = pred.agg(F.max(err)).first()[0] or 0.0
            if mx == 0:
                trees.append(tree)
                alphas.append(1.0)
                break
            loss = err / F.lit(mx)
            ebar = pred.agg(F.sum(F.col("__w") * loss) / F.sum("__w")).first()[0]
            if ebar >= 0.5:
                break
            beta = ebar / (1 - ebar)
            trees.append(tree)
            alphas.append(math.log(1 / max(beta, 1e-300)))
            data = pred.withColumn("__w", F.col("__w") * F.pow(F.lit(beta), 1 - loss)).drop("prediction")
        else:
            wrong = (F.col("prediction") != F.col("__t").cast("string")).cast("double")
            e = pred.agg(F.sum(F.col("__w") * wrong) / F.sum("__w")).first()[0]
            if e >= 1 - 1.0 / K:
                break
            a = math.log((1 - e) / max(e, 1e-300)) + math.log(K - 1)
            trees.append(tree)
            alphas.append(a)
            if e == 0:
                break
            data = pred.withColumn("__w", F.col("__w") * F.exp(F.lit(a) * wrong)).drop("prediction")
        s = data.agg(F.sum("__w")).first()[0]
        data = data.withColumn("__w", F.col("__w") / F.lit(s))
        if r % 5 == 4:
            data = cut_lineage(data)
    return BoostModel(trees, alphas, task, classes)
