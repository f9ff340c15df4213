"""Explanation tables.

Every table is computed by Spark over the scored rows; the reference's work
caps (200 explained rows, 100 background points, 500 plotted points) are kept
as explicit, seeded parameters because there they are the feature.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from quarry.functions.exprs import col, key_hash, to_double
from quarry.functions.quantiles import column_quantiles
from quarry.operators import linear, metrics


def model_importance(model, features: Sequence[str], top: int = 30):
    """Tree importances or mean |coef| per feature, top ``top`` (driver-size)."""
    if hasattr(model, "model") and hasattr(model.model, "featureImportances"):
        imp = model.model.featureImportances.toArray()
    elif hasattr(model, "coef"):
        imp = np.abs(np.asarray(model.coef))
    elif hasattr(model, "params") and "W" in getattr(model, "params", {}):
        imp = np.abs(np.asarray(model.params["W"])).mean(axis=0 if np.asarray(model.params["W"]).ndim == 2 else None)
    else:
        raise ValueError("model exposes neither importances nor coefficients")
    rows = sorted(zip(features, map(float, imp)), key=lambda t: -t[1])[:top]
    return rows


def _score(df: DataFrame, y: str, pred: str, task: str) -> float:
    if task == "regression":
        return metrics.regression_metrics(df, y, pred, median=False).first()["r2"]
    return df.agg(F.avg((col(y).cast("string") == col(pred).cast("string")).cast("double"))).first()[0]


def permutation_importance(model, df: DataFrame, features: Sequence[str], target: str, key_cols: Sequence[str],
                           task: str = "regression", repeats: int = 5, seed: int = 42) -> DataFrame:
    """Score drop when one feature's values are permuted.

    The permutation is a rank join: rows ranked by md5(key) receive the values
    of the row with the same rank under md5(seed|repeat|key). Both ranks come
    from the distributed bucket-rank helper (no single-task window). A repeat's
    ranks and join serve all features.
    """
    from quarry.sources.sinks import _distributed_rank
    feats, keys = list(features), list(key_cols)
    used = [*feats, *(model.features if hasattr(model, "predict_expr") else df.columns), target, *keys]
    src = df.select(*[col(c) for c in dict.fromkeys(used)]).persist(StorageLevel.MEMORY_AND_DISK)
    base = _score(model.transform(src), target, "prediction", task)
    ranked = _distributed_rank(src.withColumn("__k0", key_hash("perm-base", keys)), "__k0")
    r0 = ranked.drop("__k0").withColumnRenamed("__rank", "__r").persist(StorageLevel.MEMORY_AND_DISK)
    drops: dict[str, list] = {f: [] for f in feats}
    for rep in range(repeats):
        hashed = src.select(key_hash(f"{seed}|{rep}", keys).alias("__k1"), *[to_double(f).alias(f"__v{i}") for i, f in enumerate(feats)])
        donor = _distributed_rank(hashed, "__k1").drop("__k1").withColumnRenamed("__rank", "__r")
        joined = r0.join(donor, "__r").persist(StorageLevel.MEMORY_AND_DISK)
        for i, f in enumerate(feats):
            shuffled = joined.withColumn(f, F.col(f"__v{i}"))
            drops[f].append(base - _score(model.transform(shuffled), target, "prediction", task))
        joined.unpersist()
    r0.unpersist()
    src.unpersist()
    rows = [(f, float(np.mean(drops[f])), float(np.std(drops[f]))) for f in feats]
    return df.sparkSession.createDataFrame(rows, "feature string, importance_mean double, importance_sd double")


def partial_dependence(model, df: DataFrame, feature: str, grid_points: int = 50,
                       lo_q: float = 0.05, hi_q: float = 0.95) -> DataFrame:
    """Mean prediction with ``feature`` forced to each grid value.

    The grid has ``grid_points`` values between the 5 % and 95 % quantiles. A model
    that is one expression is averaged at every grid value in a single aggregation,
    without copies of rows. For any other model the distinct rows of its remaining
    features, with their counts, are copied to the grid and scored once.
    """
    lo, hi = column_quantiles(df, [feature], [lo_q, hi_q])[feature]
    if lo is None:
        return df.sparkSession.createDataFrame([], "value double, mean_prediction double")
    grid = sorted({float(g) for g in np.linspace(lo, hi, grid_points)})
    if hasattr(model, "predict_expr"):
        means = df.agg(*[F.avg(model.predict_expr({feature: g})).alias(f"g{i}") for i, g in enumerate(grid)])
        points = [F.struct(F.lit(g).alias("value"), F.col(f"g{i}").alias("mean_prediction")) for i, g in enumerate(grid)]
        return means.select(F.explode(F.array(*points)).alias("s")).select("s.*")
    others = [f for f in getattr(model, "features", df.columns) if f != feature]
    counted = df.groupBy(*[col(f) for f in others]).agg(F.count(F.lit(1)).alias("__n"))
    copies = (counted.withColumn("__g", F.explode(F.array(*[F.lit(g) for g in grid])))
              .withColumn(feature, F.col("__g")))
    scored = model.transform(copies).select("__g", "__n", to_double("prediction").alias("__p"))
    scored = scored.where(F.col("__p").isNotNull())
    return (scored.groupBy(F.col("__g").alias("value"))
            .agg((F.sum(F.col("__p") * F.col("__n")) / F.sum("__n")).alias("mean_prediction")))


def _coalitions(p: int, n_samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of feature sets and their kernel weights: all proper sets while there are
    at most ``n_samples``, else sets drawn in complementary pairs by the kernel."""
    if 2 ** p - 2 <= n_samples:
        Z = np.array([[(m >> j) & 1 for j in range(p)] for m in range(1, 2 ** p - 1)], float).reshape(-1, p)
        s = Z.sum(axis=1)
        return Z, (p - 1) / (np.array([math.comb(p, int(k)) for k in s]) * s * (p - s))
    rng = np.random.default_rng(seed)
    sizes = np.arange(1, p)
    share = (p - 1) / (sizes * (p - sizes))
    rows = []
    for k in rng.choice(sizes, n_samples // 2, p=share / share.sum()):
        z = np.zeros(p)
        z[rng.choice(p, k, replace=False)] = 1.0
        rows += [z, 1 - z]
    Z, n = np.unique(np.array(rows), axis=0, return_counts=True)
    return Z, n.astype(float)


def background(df: DataFrame, features: Sequence[str], size: int = 100, seed: int = 42) -> tuple[list, list]:
    """At most ``size`` weighted points that stand for all rows: the rows themselves
    if they are few, else the means and sizes of k-means clusters."""
    from quarry.operators.cluster import kmeans
    from quarry.operators.neighbors import nearest_center
    rows = df.select(*[to_double(f).alias(f) for f in features]).na.drop()
    few = rows.limit(size + 1).collect()
    if len(few) <= size:
        return [list(r) for r in few], [1 / len(few)] * len(few)
    near = nearest_center(rows, features, kmeans(rows, features, size, seed, max_iter=20).centers, "__c")
    got = near.groupBy("__c").agg(*[F.avg(f).alias(f) for f in features], F.count(F.lit(1)).alias("__n")).collect()
    n = sum(r["__n"] for r in got)
    return [[r[f] for f in features] for r in got], [r["__n"] / n for r in got]


def shap_values(model, df: DataFrame, features: Sequence[str], key_cols: Sequence[str], points: list, weights: list,
                n_samples: int = 2048, seed: int = 42) -> DataFrame:
    """Kernel SHAP of every row of ``df``: its keys and a value per feature, which add up
    to the row's prediction less the mean prediction of the background.

    The weighted least squares has the same design for all rows, so a value is a fixed
    combination of the mean predictions of the coalitions: every row is joined with
    coalitions and background points (constants of the plan), the model scores these
    hybrids, and one grouped sum gives the values. Rows that share their keys are averaged.
    """
    p = len(features)
    Z, w = _coalitions(p, n_samples, seed)
    X = Z[:, :-1] - Z[:, -1:]
    A = np.linalg.pinv((X * w[:, None]).T @ X) @ (X * w[:, None]).T if p > 1 else np.zeros((0, len(Z)))
    base = model.transform(df.sparkSession.createDataFrame([(*map(float, b), float(v)) for b, v in zip(points, weights)],
                                                          ", ".join(f"`{f}` double" for f in features) + ", `__w` double"))
    f0 = base.agg(F.sum(F.col("__w") * to_double("prediction"))).first()[0]
    # the whole set is one more coalition, scored once: it is the row's own prediction
    sets = [{"z": [int(v) for v in z], "a": list(map(float, A[:, i])), "own": 0.0} for i, z in enumerate(Z)]
    own = {"z": [1] * p, "a": [0.0] * (p - 1), "own": 1.0}
    backs = [{"b": list(map(float, b)), "w": float(v)} for b, v in zip(points, weights)]
    pairs = [{**s, **b} for s in sets for b in backs] + [{**own, "b": [0.0] * p, "w": 1.0}]
    table = F.from_json(F.lit(json.dumps(pairs)), "array<struct<z:array<int>,a:array<double>,own:double,b:array<double>,w:double>>")
    xs = [f"__x{j}" for j in range(p)]
    keys = [f"__k{j}" for j in range(len(key_cols))]
    rows = df.select(*[col(c).alias(k) for c, k in zip(key_cols, keys)], *[to_double(f).alias(x) for f, x in zip(features, xs)])
    rows = rows.where(F.coalesce(*[F.when(F.col(x).isNull() | F.isnan(x), 1) for x in xs], F.lit(0)) == 0)
    hybrids = rows.withColumn("__t", F.explode(table)).select(
        *keys, F.col("__t.a").alias("__a"), F.col("__t.own").alias("__o"), F.col("__t.w").alias("__w"), *[F.when(F.col("__t.z")[j] == 1, F.col(x)).otherwise(F.col("__t.b")[j]).alias(f)
                                               for j, (f, x) in enumerate(zip(features, xs))])
    scored = model.transform(hybrids).withColumn("__f", to_double("prediction"))
    sums = scored.groupBy(*keys).agg(
        F.sum("__o").alias("__n"), F.sum(F.col("__o") * F.col("__f")).alias("__own"),
        *[F.sum(F.col("__a")[j] * F.col("__w") * F.col("__f")).alias(f"__s{j}") for j in range(p - 1)])
    span = F.col("__own") / F.col("__n") - F.lit(f0)
    values = [F.col(f"__s{j}") / F.col("__n") - F.lit(float(A[j].sum() * f0)) - F.lit(float(A[j] @ Z[:, -1])) * span for j in range(p - 1)]
    last = span
    for v in values:
        last = last - v
    return sums.select(*[F.col(k).alias(c) for c, k in zip(key_cols, keys)], *[v.alias(f"shap_{f}") for f, v in zip(features, [*values, last])])


def kernel_shap(model, df: DataFrame, features: Sequence[str], key_cols: Sequence[str], n_explain: int | None = 200,
                n_background: int = 100, n_samples: int = 2048, seed: int = 42, train: DataFrame | None = None) -> DataFrame:
    """Mean |SHAP| per feature over ``n_explain`` rows (those of least seeded hash;
    None: all), against a background that stands for ``train`` (default: ``df``)."""
    points, weights = background(df if train is None else train, features, n_background, seed)
    if n_explain is not None:
        df = df.orderBy(key_hash(seed, list(key_cols)), *[col(c) for c in key_cols]).limit(n_explain)
    values = shap_values(model, df, features, key_cols, points, weights, n_samples, seed)
    means = values.agg(*[F.avg(F.abs(col(f"shap_{f}"))).alias(f) for f in features])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), col(f).alias("mean_abs_shap")) for f in features])).alias("r")
    return means.select(pairs).select("r.feature", "r.mean_abs_shap")


@dataclass
class PcaModel:
    """Principal components of centered rows; each component's largest loading is positive."""
    features: list
    mean: list
    components: list
    ratio: list

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, weights in enumerate(self.components):
            e = F.lit(0.0)
            for f, m, w in zip(self.features, self.mean, weights):
                e = e + (to_double(f) - F.lit(float(m))) * F.lit(float(w))
            out = out.withColumn(f"pc{c + 1}", e)
        return out

    def project(self, points: Sequence[Sequence[float]]) -> list:
        """Places of points such as cluster centers on the components."""
        return ((np.asarray(points, float) - np.array(self.mean)) @ np.array(self.components).T).tolist()


def fit_pca(df: DataFrame, features: Sequence[str], k: int = 2) -> PcaModel:
    """From ONE co-moment pass."""
    mo = linear.moments(df, list(features))[None]
    vals, vecs = np.linalg.eigh(mo.C / max(mo.n - 1, 1))
    order = np.argsort(vals)[::-1][:k]
    W = vecs[:, order].T
    W = W * np.sign(W[np.arange(len(W)), np.abs(W).argmax(axis=1)])[:, None]
    ratio = (vals[order] / vals.sum()).tolist() if vals.sum() > 0 else [0.0] * k
    return PcaModel(list(features), mo.mean[:len(features)].tolist(), W.tolist(), ratio)


def pca2(df: DataFrame, features: Sequence[str], fit_df: DataFrame | None = None, k: int = 2):
    """(frame with pc1..pck, explained variance ratios); the components are those
    of ``fit_df`` where it is given."""
    m = fit_pca(fit_df if fit_df is not None else df, features, k)
    return m.transform(df), m.ratio


def residual_rows(scored: DataFrame, y: str, pred: str, split_col: str | None = "split",
                  keep: Sequence[str] = ()) -> DataFrame:
    """Actual, predicted and residual per row, with the split."""
    cols = [col(k) for k in keep] + [to_double(y).alias("actual"), to_double(pred).alias("predicted"),
            (to_double(y) - to_double(pred)).alias("residual")]
    if split_col and split_col in scored.columns:
        cols.append(col(split_col))
    return scored.select(*cols)


def scoring_overlay(train_pairs: DataFrame, new_predictions: DataFrame, pred: str, order_cols: Sequence[str],
                    n_keep: int = 500) -> DataFrame:
    """Evenly down-sampled train/test pairs plus new predictions placed on
    the diagonal (actual = predicted)."""
    from quarry.sources.sinks import downsample_evenly
    pts = downsample_evenly(train_pairs, list(order_cols), n_keep).select(
        F.col("actual"), F.col("predicted"), F.col("split").alias("series"))
    new = new_predictions.select(to_double(pred).alias("actual"), to_double(pred).alias("predicted"),
                                 F.lit("scored").alias("series"))
    return pts.unionByName(new)
