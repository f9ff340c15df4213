"""Batch evaluation.

* ``robustness``: models x feature sets x seeds; each seed is an independent
  md5 split that keeps the target's strata; CV R2 (on the training part) plus test R2/RMSE/MAE.
* ``external_validation``: fit on one table, score another.
* ``summarize``: per (model, feature set) count, median / mean / sd of every
  metric and the 2.5 % / 97.5 % empirical interval in ONE aggregation, then
  the ranking (A16-A18).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quarry.functions.exprs import col, to_double
from quarry.functions.quantiles import column_quantiles
from quarry.operators import linear, metrics, split, transform
from quarry.plans import models, tune
from quarry.sources import sinks


def feature_sets(features: Sequence[str], keep: str | None = None) -> dict[str, list[str]]:
    """All features, plus drop-one sets that keep a named feature."""
    out = {"all": list(features)}
    for f in features:
        if f != keep and len(features) > 1:
            out[f"drop_{f}"] = [g for g in features if g != f]
    return out


# The models that are compared, with their parameters; True: inputs are scaled.
ROBUST_MODELS = {
    "LinearRegression": ("Linear", {}, True),
    "Ridge": ("Ridge", {"alpha": 1.0}, True),
    "ElasticNet": ("ElasticNet", {"alpha": 0.01, "l1_ratio": 0.5}, True),
    "BayesianRidge": ("BayesianRidge", {}, True),
    "SVR_RBF": ("SVM", {"C": 10.0, "epsilon": 0.1, "kernel": "rbf"}, True),
    "KNN": ("K-Nearest", {"n_neighbors": 7, "weights": "distance"}, True),
    "GradientBoosting": ("gradient_boosting", {}, False),
    "HistGradientBoosting": ("HistGradientBoosting", {}, False),
    "RandomForest": ("RF", {"n_estimators": 500}, False),
    "ExtraTrees": ("ExtraTrees", {"n_estimators": 500}, False),
}


@dataclass
class Prepared:
    """A model behind a median imputer and a scaler, both fitted on its training rows.
    ``known`` keeps both for models that share the same rows: columns are fitted once."""
    key: str
    params: dict
    scaler: str = "standard"
    known: dict | None = None

    def scale(self, train: DataFrame, feats: list[str]):
        """The scaler of training rows without missing values."""
        known = {} if self.known is None else self.known
        found = known.get(self.scaler)
        if found is None or not set(feats) <= found[0]:
            found = known[self.scaler] = (set(feats), transform.fit_scaler(train, feats, self.scaler))
        return found[1]

    def fit_moments(self, train: DataFrame, total: linear.Moments, feats: list[str], target: str) -> linear.LinearModel:
        """The model of a Gram key in raw units, from ``total``, the moments of the features
        and target of training rows without missing features: their medians aren't used."""
        sc = self.scale(train, feats)
        center, scale = np.array([sc.center[f] for f in feats]), np.array([sc.scale[f] for f in feats])
        m = models.make(self.key, self.params, prescaled=True).fit_moments(
            total.rescaled([*center, 0.0], [*scale, 1.0]), feats, target)
        return linear.LinearModel(feats, m.coef / scale, float(m.intercept - m.coef @ (center / scale)), target, m.info)

    def fit(self, df: DataFrame, features: Sequence[str], target: str):
        feats = list(features)
        known = {} if self.known is None else self.known
        middle = known.setdefault("middle", {})
        todo = [f for f in feats if f not in middle]
        middle.update({f: q[0] for f, q in column_quantiles(df, todo, [0.5]).items()})

        def filled(frame):
            return frame.withColumns({f: F.coalesce(F.nanvl(to_double(f), F.lit(None)), F.lit(middle[f])) for f in feats})
        train = filled(df)
        scale = self.scale(train, feats)
        model = models.make(self.key, self.params, prescaled=True).fit(scale.transform(train, feats), feats, target)

        class _Fitted:
            def transform(self_inner, frame):
                # the caller's features come back as they were
                raw = {f: f"__raw_{i}" for i, f in enumerate(feats)}
                out = model.transform(scale.transform(filled(frame.withColumns({v: col(k) for k, v in raw.items()})), feats))
                return out.withColumns({k: col(v) for k, v in raw.items()}).drop(*raw.values())
        return _Fitted()


def robustness(df: DataFrame, features_by_set: dict, target: str, model_keys: Sequence[str] | dict,
               seeds: Sequence[int], key_cols: Sequence[str], test_size: float = 0.2,
               cv_folds: int = 5, scaler: str = "standard", strata: bool = True, seeded: dict | None = None) -> DataFrame:
    """One row per (seed, feature set, model): the mean and sd of R2 over folds of
    the training part, test metrics, and the rows of both parts. ``model_keys``: keys, or a
    table like ``ROBUST_MODELS``. ``strata``: every split keeps the shares of the target's
    quantile bins (B6). Missing features take the training rows' median. ``seeded``: the
    name of the parameter of a model key that takes the seed."""
    table = model_keys if isinstance(model_keys, dict) else {k: (k, {}, True) for k in model_keys}
    seeded = {"RF": "random_state", "ExtraTrees": "random_state"} if seeded is None else seeded
    rows = []
    spark = df.sparkSession
    if strata:
        df, _, _ = split.robustness_strata(df, target)
    every = list(dict.fromkeys(f for feats in features_by_set.values() for f in feats))
    seen = df.agg(*[F.count_if(to_double(f).isNull() | F.isnan(to_double(f))).alias(f"m{i}") for i, f in enumerate(every)]).first() if every else ()
    missing = {f for f, n in zip(every, seen) if n}
    jobs = [(set_name, list(feats), name, key, params, scaler if scaled else "none")
            for set_name, feats in sorted(features_by_set.items(), key=lambda x: -len(x[1]))  # scales are first fitted for the largest set
            for name, (key, params, scaled) in table.items()]
    # without missing values the Gram models of all sets, and their folds, follow from one pass, and are scored in another
    by_moments = {(j[0], j[2]): missing.isdisjoint(j[1]) and tune._gram_route(j[3], j[5], "none")
                  and j[5] in ("none", *transform.AFFINE) for j in jobs}
    rest = not all(by_moments.values())
    prefixes: dict = {}
    if not rest:  # no other column is read; what is kept is a few numbers a row, and splits are read off it
        df = df.select(*[col(c) for c in dict.fromkeys([*key_cols, *every, target, *(["__stratum"] if strata else [])])])
        df, prefixes = split.hash_prefixes(df, list(key_cols), seeds)
        df = df.persist()
    for seed in seeds:
        sp = split.train_test_split(df, list(key_cols), test_size, seed, "__stratum" if strata else None, prefix=prefixes.get(seed))
        # folds, medians, scales and fold moments are the same for all models and sets
        sp = sp.persist() if rest else sp
        tr, te = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
        frames = tune.fold_frames(tr, key_cols, cv_folds, seed=seed, prefix=prefixes.get(seed))
        frames = [(frame.persist() if rest else frame, held_out) for frame, held_out in frames]
        size = {r["split"]: r["count"] for r in sp.groupBy("split").count().collect()}
        known: dict = {}

        def told(params, key):
            return {**params, **({seeded[key]: int(seed)} if key in seeded else {})}

        def add(set_name, name, cv, test):
            rows.append((int(seed), set_name, name, float(cv[0]), *test, float(cv[1]), int(size.get("train", 0)), int(size.get("test", 0))))
        quick = [j for j in jobs if by_moments[j[0], j[2]]]
        if quick:
            (frame, held_out), = frames
            wide = list(dict.fromkeys(f for j in quick for f in j[1]))
            fm = linear.moments(frame, [*wide, target], group="fold")
            of_set = {j[0]: {g: mo.of([*map(wide.index, j[1]), len(wide)]) for g, mo in fm.items()} for j in quick}
            cvs = tune.gram_scores(frame, held_out, [(feats, key, how != "none", False, told(params, key), of_set[s])
                                                     for s, feats, _, key, params, how in quick], target)
            fitted = [Prepared(key, told(params, key), how, known).fit_moments(tr, linear.sum_moments(of_set[s]), feats, target)
                      for s, feats, _, key, params, how in quick]
            tests = metrics.regression_scores(te, target, [m.predict_expr() for m in fitted])
            for j, cv, test in zip(quick, cvs, tests):
                r2 = [r[1] for r in cv]
                add(j[0], j[2], (np.mean(r2), np.std(r2)), test[()])
        for set_name, feats, name, key, params, how in (j for j in jobs if not by_moments[j[0], j[2]]):
            params = told(params, key)
            gram = missing.isdisjoint(feats) and tune._gram_route(key, how, "none")
            make = None if gram else (lambda k=key, p=params, h=how: Prepared(k, p, h))
            _, cv = tune.cross_validate(tr, feats, target, key, key_cols, cv_folds, seed=seed, scaler=how if make is None else "none",
                                        factory=make, params=params, frames=frames)
            cv = cv.first()
            m = Prepared(key, params, how, known).fit(tr, feats, target)
            r = metrics.regression_metrics(m.transform(te), target, "prediction", median=False).first()
            add(set_name, name, (cv["r2_mean"], cv["r2_sd"]), (r["r2"], r["rmse"], r["mae"]))
        if rest:
            for frame, _ in frames:
                frame.unpersist()
            sp.unpersist()
    if not rest:
        df.unpersist()
    place = {(s, name): i for i, (s, name) in enumerate((s, name) for s in features_by_set for name in table)}
    rows.sort(key=lambda r: (list(map(int, seeds)).index(r[0]), place[r[1], r[2]]))
    return spark.createDataFrame(rows, "seed int, feature_set string, model string, cv_r2 double, test_r2 double, rmse double, "
                                       "mae double, cv_r2_sd double, n_train long, n_test long")


def write_robustness(per_seed: DataFrame, folder: str, fmt: str = "csv") -> dict[str, str]:
    """The table per seed and its summary, under ``folder``."""
    return sinks.write_sheets({"per_seed_results": per_seed, "summary": summarize(per_seed)}, folder, fmt)


def external_validation(train_df: DataFrame, external_df: DataFrame, features: Sequence[str], target: str,
                        candidates: Sequence[str], external_target: str | None = None,
                        scaler: str = "standard") -> DataFrame:
    """Candidates 'Model' or 'Model:outlier_mode' (none / winsor)."""
    ext_t = external_target or target
    rows = []
    for cand in candidates:
        key, _, mode = cand.partition(":")
        tr = train_df
        if mode == "winsor":
            w = transform.fit_winsorizer(tr, list(features))
            tr, ext = w.transform(tr), w.transform(external_df)
        else:
            ext = external_df
        sc = transform.fit_scaler(tr, list(features), scaler)
        m = models.make(key, prescaled=True).fit(sc.transform(tr, list(features)), list(features), target)
        pred = m.transform(sc.transform(ext, list(features)))
        r = metrics.regression_metrics(pred.withColumnRenamed(ext_t, "__y") if ext_t != target else pred,
                                       "__y" if ext_t != target else target, "prediction", median=False).first()
        rows.append((cand, r["n"], r["r2"], r["rmse"], r["mae"]))
    return train_df.sparkSession.createDataFrame(rows, "candidate string, n long, r2 double, rmse double, mae double")


def summarize(per_seed: DataFrame, group: Sequence[str] = ("model", "feature_set"),
              value_cols: Sequence[str] = ("cv_r2", "test_r2", "rmse", "mae"),
              rank_by: str = "median") -> DataFrame:
    """A16/A17/A18 in one aggregation + ordering."""
    aggs = [F.count(F.lit(1)).alias("n_seeds")]
    for c in value_cols:
        # one value per seed of a group: the buffer is bounded by the number of seeds
        q = F.percentile(F.col(c), F.array(*[F.lit(p) for p in (0.5, 0.025, 0.975)]))
        aggs += [q[0].alias(f"{c}_median"), F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"),
                 q[1].alias(f"{c}_p2_5"), q[2].alias(f"{c}_p97_5")]
    out = per_seed.groupBy(*group).agg(*aggs)
    first = value_cols[1] if len(value_cols) > 1 else value_cols[0]
    order = ([F.desc(f"{first}_p2_5"), F.desc(f"{first}_median")] if rank_by == "lower"
             else [F.desc(f"{first}_median")])
    return out.orderBy(*order, *group)
