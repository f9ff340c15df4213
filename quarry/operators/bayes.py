"""Moment/count-based classifiers (M family: C3-C9).

Fitting is one ``groupBy(class)`` aggregation (counts, sums, squares or
per-level counts); the fitted table has one row per class (bounded by the
class count). Scoring is a JVM expression per class: joint log-likelihoods,
arg-max with ties to the first class in label order, and soft-max
probabilities.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.exprs import col, to_double
from quarry.functions.labels import order_labels


@dataclass
class ScoreModel:
    """Generic per-class linear/quadratic scorer: jll_c(x) = expression."""
    classes: list
    features: list
    kind: str
    params: dict = field(default_factory=dict)

    def jll(self, c_idx: int) -> Column:
        p = self.params
        xs = [to_double(f) for f in self.features]
        if self.kind == "gaussian":
            m, v, lp = p["mean"][c_idx], p["var"][c_idx], p["log_prior"][c_idx]
            e = F.lit(lp - 0.5 * sum(math.log(2 * math.pi * vi) for vi in v))
            for x, mi, vi in zip(xs, m, v):
                e = e - F.lit(0.5 / vi) * (x - F.lit(mi)) * (x - F.lit(mi))
            return e
        if self.kind in ("linear",):  # w_c . x + b_c (multinomial/complement/bernoulli/LDA)
            w, b = p["W"][c_idx], p["b"][c_idx]
            e = F.lit(float(b))
            for x, wi in zip(xs, w):
                if wi != 0:
                    e = e + F.lit(float(wi)) * x
            return e
        if self.kind == "bernoulli":
            w, b = p["W"][c_idx], p["b"][c_idx]
            e = F.lit(float(b))
            for x, wi in zip(xs, w):
                e = e + F.lit(float(wi)) * F.when(x > F.lit(p["binarize"]), 1.0).otherwise(0.0)
            return e
        if self.kind == "quadratic":  # QDA: -0.5 (x-m)' S^-1 (x-m) + const
            m, Si, const = p["mean"][c_idx], p["prec"][c_idx], p["const"][c_idx]
            d = [x - F.lit(mi) for x, mi in zip(xs, m)]
            e = F.lit(float(const))
            for i in range(len(d)):
                for j in range(len(d)):
                    if Si[i][j] != 0:
                        e = e - F.lit(0.5 * Si[i][j]) * d[i] * d[j]
            return e
        if self.kind == "categorical":
            lp, tables = p["log_prior"][c_idx], p["log_prob"][c_idx]
            e = F.lit(float(lp))
            for f_i, f in enumerate(self.features):
                m = F.create_map(*[x for lvl, v in tables[f_i].items() for x in (F.lit(lvl), F.lit(float(v)))])
                e = e + F.coalesce(F.element_at(m, col(f).cast("string")), F.lit(float(p["unseen"][c_idx][f_i])))
            return e
        raise ValueError(self.kind)

    def transform(self, df: DataFrame, pred_col: str = "prediction", prob_prefix: str = "prob_",
                  with_probs: bool = True) -> DataFrame:
        k = len(self.classes)
        scores = [self.jll(i) for i in range(k)]
        out = df.withColumn("__jll", F.array(*scores))
        mx = F.array_max(F.col("__jll"))
        # arg-max, ties -> first class in label order
        pred = None
        for i in reversed(range(k)):
            cond = F.col("__jll")[i] == mx
            pred = F.when(cond, F.lit(self.classes[i])) if pred is None else F.when(cond, F.lit(self.classes[i])).otherwise(pred)
        out = out.withColumn(pred_col, pred)
        if with_probs:
            z = F.aggregate(F.col("__jll"), F.lit(0.0), lambda acc, v: acc + F.exp(v - mx))
            for i, c in enumerate(self.classes):
                out = out.withColumn(f"{prob_prefix}{c}", F.exp(F.col("__jll")[i] - mx) / z)
        return out.drop("__jll")

    def to_json(self) -> str:
        return json.dumps({"classes": self.classes, "features": self.features, "kind": self.kind,
                           "params": self.params})


def _class_stats(df: DataFrame, features: Sequence[str], label: str):
    xs = [to_double(f) for f in features]
    rows = (df.where(col(label).isNotNull()).groupBy(col(label).cast("string").alias("__y"))
            .agg(F.count(F.lit(1)).alias("n"),
                 *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)],
                 *[F.var_pop(x).alias(f"v{i}") for i, x in enumerate(xs)],
                 *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)]).collect())  # one row per class
    classes = order_labels([r["__y"] for r in rows])
    by = {r["__y"]: r for r in rows}
    p = len(features)
    n = np.array([by[c]["n"] for c in classes], float)
    M = np.array([[by[c][f"m{i}"] for i in range(p)] for c in classes], float)
    V = np.array([[by[c][f"v{i}"] for i in range(p)] for c in classes], float)
    S = np.array([[by[c][f"s{i}"] for i in range(p)] for c in classes], float)
    return classes, n, M, V, S


def fit_gaussian_nb(df: DataFrame, features: Sequence[str], label: str,
                    var_smoothing: float = 1e-9) -> ScoreModel:
    """Per-class mean/variance; variance += var_smoothing * max feature variance."""
    classes, n, M, V, _ = _class_stats(df, features, label)
    tot = df.where(col(label).isNotNull()).agg(*[F.var_pop(to_double(f)).alias(f"v{i}")
                                                  for i, f in enumerate(features)]).first()
    eps = var_smoothing * max([tot[f"v{i}"] or 0.0 for i in range(len(features))] + [0.0])
    V = V + eps
    return ScoreModel(classes, list(features), "gaussian",
                      {"mean": M.tolist(), "var": V.tolist(), "log_prior": np.log(n / n.sum()).tolist()})


def fit_multinomial_nb(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0) -> ScoreModel:
    """Feature counts per class (features must be non-negative, e.g. min-max scaled)."""
    classes, n, _, _, S = _class_stats(df, features, label)
    fc = S + alpha
    W = np.log(fc) - np.log(fc.sum(axis=1, keepdims=True))
    b = np.log(n / n.sum())
    return ScoreModel(classes, list(features), "linear", {"W": W.tolist(), "b": b.tolist()})


def fit_complement_nb(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0,
                      norm: bool = False) -> ScoreModel:
    """Weights from the complement of each class's feature counts."""
    classes, n, _, _, S = _class_stats(df, features, label)
    comp = S.sum(axis=0, keepdims=True) - S + alpha
    logp = np.log(comp / comp.sum(axis=1, keepdims=True))
    W = -logp
    if norm:
        W = W / np.abs(W).sum(axis=1, keepdims=True)
    b = np.zeros(len(classes)) if len(classes) > 1 else np.log(n / n.sum())
    return ScoreModel(classes, list(features), "linear", {"W": W.tolist(), "b": b.tolist()})


def fit_bernoulli_nb(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0,
                     binarize: float = 0.0) -> ScoreModel:
    """P(x_j > binarize | class) with Laplace smoothing."""
    xs = [F.when(to_double(f) > F.lit(binarize), 1.0).otherwise(0.0) for f in features]
    rows = (df.where(col(label).isNotNull()).groupBy(col(label).cast("string").alias("__y"))
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)]).collect())
    classes = order_labels([r["__y"] for r in rows])
    by = {r["__y"]: r for r in rows}
    n = np.array([by[c]["n"] for c in classes], float)
    S = np.array([[by[c][f"s{i}"] for i in range(len(features))] for c in classes], float)
    P = (S + alpha) / (n[:, None] + 2 * alpha)
    W = np.log(P) - np.log(1 - P)
    b = np.log(n / n.sum()) + np.log(1 - P).sum(axis=1)
    return ScoreModel(classes, list(features), "bernoulli", {"W": W.tolist(), "b": b.tolist(), "binarize": binarize})


def fit_categorical_nb(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0) -> ScoreModel:
    """(class, feature, level) counts; one long groupBy over stacked cells."""
    y = col(label).cast("string")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), col(f).cast("string").alias("lvl"))
                                for i, f in enumerate(features)]))
    long = df.where(col(label).isNotNull()).select(y.alias("__y"), cells.alias("c")).select("__y", "c.f", "c.lvl")
    counts = long.groupBy("__y", "f", "lvl").count().collect()  # classes x features x levels
    ncls = {r["__y"]: r["n"] for r in df.groupBy(y.alias("__y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = order_labels(list(ncls))
    levels = [sorted({r["lvl"] for r in counts if r["f"] == i and r["lvl"] is not None}) for i in range(len(features))]
    tab = {(r["__y"], r["f"], r["lvl"]): r["count"] for r in counts}
    n = np.array([ncls[c] for c in classes], float)
    log_prob, unseen = [], []
    for c in classes:
        per_f, un = [], []
        for i in range(len(features)):
            L = len(levels[i])
            tot = sum(tab.get((c, i, lv), 0) for lv in levels[i])
            per_f.append({lv: math.log((tab.get((c, i, lv), 0) + alpha) / (tot + alpha * L)) for lv in levels[i]})
            un.append(math.log(alpha / (tot + alpha * L)) if tot + alpha * L > 0 else 0.0)
        log_prob.append(per_f)
        unseen.append(un)
    return ScoreModel(classes, list(features), "categorical",
                      {"log_prior": np.log(n / n.sum()).tolist(), "log_prob": log_prob, "unseen": unseen})


def _pooled_cov(df: DataFrame, features, label):
    from quarry.operators.linear import moments
    groups = moments(df.withColumn("__y", col(label).cast("string")), list(features), group="__y")
    classes = order_labels(list(groups))
    return classes, groups


def fit_lda(df: DataFrame, features: Sequence[str], label: str) -> ScoreModel:
    """Class means + pooled within-class covariance (one grouped moments pass)."""
    classes, groups = _pooled_cov(df, features, label)
    p = len(features)
    n_tot = sum(groups[c].n for c in classes)
    Sw = sum(groups[c].C for c in classes) / max(n_tot - len(classes), 1)
    Si = np.linalg.pinv(Sw)
    W, b = [], []
    for c in classes:
        m = groups[c].mean
        W.append((Si @ m).tolist())
        b.append(float(-0.5 * m @ Si @ m + math.log(groups[c].n / n_tot)))
    return ScoreModel(classes, list(features), "linear", {"W": W, "b": b})


def fit_qda(df: DataFrame, features: Sequence[str], label: str, reg: float = 0.0) -> ScoreModel:
    """C4: per-class covariance (sample), quadratic discriminant."""
    classes, groups = _pooled_cov(df, features, label)
    p = len(features)
    n_tot = sum(groups[c].n for c in classes)
    means, precs, consts = [], [], []
    for c in classes:
        g = groups[c]
        S = g.C / max(g.n - 1, 1) + reg * np.eye(p)
        sign, logdet = np.linalg.slogdet(S)
        means.append(g.mean.tolist())
        precs.append(np.linalg.pinv(S).tolist())
        consts.append(float(-0.5 * logdet + math.log(g.n / n_tot)))
    return ScoreModel(classes, list(features), "quadratic", {"mean": means, "prec": precs, "const": consts})
