"""Cross-validation and hyper-parameter search.

Folds come from the seeded md5 fold assignment (B11/B12). Preprocessing is
refit inside every fold (scaler fit on the fold's training part). Gram-family
models use the one-pass fold-moment route: a single ``groupBy(fold)``
produces every fold's statistics and each training part is (total - fold).
"""

from __future__ import annotations

import itertools
import random
from typing import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quarry.operators import linear, metrics, split, transform
from quarry.plans import models

GRAM_METHODS = {"Linear": "ols", "Ridge": "ridge", "Lasso": "lasso", "ElasticNet": "elasticnet"}
REPEATS = 2      # of the repeated kinds
TEST_SIZE = 0.2  # of the shuffled kinds


def _stratify(kind: str, target: str | None) -> str | None:
    """Stratified kinds need a class target; without one they run plain."""
    return target if kind in ("StratifiedKFold", "RepeatedStratifiedKFold", "StratifiedShuffleSplit") else None


def fold_frames(df: DataFrame, key_cols: Sequence[str], k: int = 5, kind: str = "KFold", seed: int = 42,
                target: str | None = None, prefix: str | None = None) -> list[tuple[DataFrame, list[int]]]:
    """Frames with a ``fold`` column and the folds to hold out in each: one frame for
    k-fold, one per repeat for the repeated kinds, one per split (held out: fold 0)
    for the shuffled kinds. Fewer than two folds become five; unknown kinds are KFold.
    ``prefix``: the seed's column of ``split.hash_prefixes``."""
    k = 5 if not k or k < 2 else k
    strat = _stratify(kind, target)
    if "ShuffleSplit" in kind:
        return [(split.train_test_split(df, list(key_cols), TEST_SIZE, seed + i, strat)
                 .withColumn("fold", F.when(F.col("split") == "test", 0).otherwise(1)).drop("split"), [0]) for i in range(k)]
    repeats = REPEATS if kind.startswith("Repeated") else 1
    return [(split.kfold(df, list(key_cols), k, seed + r, stratify=strat, prefix=prefix if r == 0 else None), list(range(k)))
            for r in range(repeats)]


def _gram_route(model_key: str, scaler: str, y_scaler: str) -> bool:
    """Whether fold moments give the model: they know standardised and raw columns,
    and least squares doesn't depend on the scale."""
    return model_key == "Linear" or model_key in GRAM_METHODS and {scaler, y_scaler} <= {"standard", "none"}


def gram_scores(frame: DataFrame, held_out: list[int], jobs: Sequence[tuple], target: str) -> list[list[tuple]]:
    """Per job (features, model key, scale x, scale y, params, moments of each fold):
    (fold, R2, RMSE, MAE) of every held-out part, whose model is that of the other
    folds' moments. All jobs' predictions are scored in ONE grouped pass."""
    fitted = []
    for feats, key, scale_x, scale_y, params, fm in jobs:
        total = linear.sum_moments(fm)
        fitted.append({f: linear.fit_moments(total.minus(fm[f]), feats, target, GRAM_METHODS[key], scale_x, scale_y, **(params or {}))
                       for f in held_out})
    held, preds = linear.predict_by(frame, fitted, "fold")
    scores = metrics.regression_scores(held, target, preds, ["fold"])
    return [sorted((int(f), *s) for (f,), s in found.items()) for found in scores]


def cross_validate(df: DataFrame, features: Sequence[str], target: str, model_key: str,
                   key_cols: Sequence[str], k: int = 5, kind: str = "KFold", seed: int = 42,
                   scaler: str = "standard", factory: Callable | None = None, params: dict | None = None,
                   y_scaler: str = "none", frames: list | None = None, fold_moments: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores per held-out part (numbered through all repeats and splits) and
    mean +- population sd.

    Both scalers are fitted on the training part of each fold; predictions go back to
    the target's own units before scoring. Regression: R2, RMSE, MAE. Classification:
    accuracy and weighted precision / recall / F1. ``frames`` (persisted by the caller)
    and their ``fold_moments`` are given when several models share the folds.
    """
    task, feats, spark = models.problem_type(model_key), list(features), df.sparkSession
    scaler, y_scaler = (scaler or "none").lower(), (y_scaler or "none").lower()
    rows: list[tuple] = []
    own = frames is None
    if own:
        frames = fold_frames(df, key_cols, k, kind, seed, target if task == "classification" else None)
    for i, (frame, held_out) in enumerate(frames):
        frame = frame.persist() if own else frame
        start = len(rows)
        if task == "regression" and factory is None and _gram_route(model_key, scaler, y_scaler):
            fm = fold_moments[i] if fold_moments else linear.moments(frame, feats + [target], group="fold")
            got = gram_scores(frame, held_out, [(feats, model_key, scaler != "none", y_scaler != "none", params, fm)], target)[0]
            rows += [(start + f, *scores) for f, *scores in got]
        else:
            classes = None
            for f in held_out:
                tr, te = frame.where(F.col("fold") != f), frame.where(F.col("fold") == f)
                xs = transform.fit_scaler(tr, feats, scaler)
                tr, te = xs.transform(tr, feats), xs.transform(te, feats)
                ys = None
                if task == "regression" and y_scaler != "none":
                    ys = transform.fit_scaler(tr, [target], y_scaler)
                    if not isinstance(ys, transform.ScalerModel):
                        raise ValueError(f"{y_scaler} has no inverse for the target")
                    tr = ys.transform(tr, [target])
                m = (factory() if factory else models.make(model_key, params, prescaled=True)).fit(tr, feats, target)
                pred = m.transform(te)
                if ys is not None:
                    pred = pred.withColumn("prediction", ys.inverse_expr(target, F.col("prediction")))
                if task == "regression":
                    r = metrics.regression_metrics(pred, target, "prediction", median=False).first()
                    rows.append((start + f, r["r2"], r["rmse"], r["mae"]))
                else:
                    from quarry.operators.native import class_list
                    classes = classes or class_list(frame, target)  # one value per class, in bin order
                    s = metrics.classification_summary(pred, target, "prediction", classes).first()
                    rows.append((start + f, s["accuracy"], s["precision_weighted"], s["recall_weighted"], s["f1_weighted"]))
        if own:
            frame.unpersist()
    schema = ("fold int, r2 double, rmse double, mae double" if task == "regression" else
              "fold int, accuracy double, precision double, recall double, f1 double")
    fold_df = spark.createDataFrame(sorted(rows), schema)
    value_cols = [c for c in fold_df.columns if c != "fold"]
    summary = fold_df.agg(*[x for c in value_cols for x in
                            (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd"))])
    return fold_df, summary


def _combos(grid: dict) -> list[dict]:
    keys = sorted(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def _distance(a: dict, b: dict, grid: dict) -> float:
    """How far two settings lie apart on the grid, every parameter alike."""
    d = 0.0
    for key, values in grid.items():
        d += ((values.index(a[key]) - values.index(b[key])) / max(len(values) - 1, 1)) ** 2
    return d


def _next_setting(left: list[dict], seen: list[tuple[dict, float]], grid: dict) -> dict:
    """The untried setting of largest upper confidence under a kernel-smoothed
    surrogate of the scores so far."""
    scores = np.array([s for _, s in seen])
    spread = float(scores.std()) or 1.0

    def bound(c):
        w = np.exp(-8.0 * np.array([_distance(c, s, grid) for s, _ in seen]))
        mean = float((w * scores).sum() + scores.mean() * 0.1) / float(w.sum() + 0.1)
        return mean + spread / np.sqrt(1.0 + w.sum())
    return max(left, key=bound)


def search(df: DataFrame, features: Sequence[str], target: str, model_key: str, grid: dict,
           make_trainer: Callable[[dict], object] | None = None, key_cols: Sequence[str] = (), k: int = 5,
           how: str = "grid", n_iter: int = 10, seed: int = 42, refit: bool = False, **cv):
    """T1 (grid), T2 (seeded random subset of the grid), T3 ('bayes': settings are
    tried one after another where a surrogate of the scores so far promises most).

    Score: mean over folds of minus the squared error (regression) or of accuracy.
    Returns (params and score per setting, best setting), and with ``refit`` also the
    model fitted to all rows with the best setting."""
    combos = _combos(grid)
    task = models.problem_type(model_key)

    def score(params):
        given = {"factory": lambda: make_trainer(params)} if make_trainer else {"params": params}
        folds, _ = cross_validate(df, features, target, model_key, key_cols, k, seed=seed, **given, **cv)
        value = F.avg(-F.col("rmse") * F.col("rmse")) if task == "regression" else F.avg("accuracy")
        return float(folds.agg(value).first()[0])

    tried: list[tuple[dict, float]] = []
    if how == "bayes":
        left = list(combos)
        first = random.Random(seed).sample(left, min(3, len(left)))
        while left and len(tried) < n_iter:
            c = first[len(tried)] if len(tried) < len(first) else _next_setting(left, tried, grid)
            left.remove(c)
            tried.append((c, score(c)))
    else:
        if how == "random" and len(combos) > n_iter:
            combos = random.Random(seed).sample(combos, n_iter)
        tried = [(c, score(c)) for c in combos]
    best = max(range(len(tried)), key=lambda i: (tried[i][1], -i))
    res = df.sparkSession.createDataFrame([(str(c), s) for c, s in tried], "params string, score double")
    if not refit:
        return res, tried[best][0]
    trainer = make_trainer(tried[best][0]) if make_trainer else models.make(model_key, tried[best][0])
    return res, tried[best][0], trainer.fit(df, list(features), target)


def gram_alpha_search(df: DataFrame, features: Sequence[str], target: str, key_cols: Sequence[str],
                      method: str = "ridge", alphas: Sequence[float] = (0.01, 0.1, 1.0, 10.0, 100.0),
                      k: int = 5, seed: int = 42) -> tuple[float, dict]:
    """T1 for Gram models: every alpha x fold from ONE groupBy(fold) pass."""
    folded = split.kfold(df, list(key_cols), k, seed)
    return linear.cv_path_select(folded, features, target, "fold", method, list(alphas))
