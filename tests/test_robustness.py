import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from quarry.operators import split
from quarry.plans import batch
from quarry.plans.common import LI_FEATS, LI_KEYS, LI_TARGET


def design(rows, feats):
    return np.array([[1.0, *[float(r[f]) for f in feats]] for r in rows]), np.array([float(r[LI_TARGET]) for r in rows])


def ols_r2(train, test, feats):
    (a, y), (b, z) = design(train, feats), design(test, feats)
    e = z - b @ np.linalg.lstsq(a, y, rcond=None)[0]
    return 1 - np.mean(e * e) / np.var(z), np.sqrt(np.mean(e * e))


def test_robustness_matches_brute_force(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").limit(800).cache()
    sets = batch.feature_sets(LI_FEATS, "l_quantity")
    got = batch.robustness(li, sets, LI_TARGET, ["Linear", "Ridge"], [1, 2], LI_KEYS).collect()
    assert {(r.seed, r.feature_set, r.model) for r in got} == {(s, f, m) for s in (1, 2) for f in sets for m in ("Linear", "Ridge")}
    for seed in (1, 2):
        sp = split.train_test_split(split.robustness_strata(li, LI_TARGET)[0], LI_KEYS, 0.2, seed, "__stratum")
        train = split.kfold(sp.where(F.col("split") == "train"), LI_KEYS, 5, seed).collect()
        test = sp.where(F.col("split") == "test").collect()
        for r in (r for r in got if r.seed == seed and r.model == "Linear"):
            feats = sets[r.feature_set]
            assert np.allclose((r.test_r2, r.rmse), ols_r2(train, test, feats), rtol=1e-8)
            cv = [ols_r2([x for x in train if x.fold != k], [x for x in train if x.fold == k], feats)[0] for k in range(5)]
            assert np.isclose(r.cv_r2, np.mean(cv), rtol=1e-8) and np.isclose(r.cv_r2_sd, np.std(cv), rtol=1e-6)
            assert (r.n_train, r.n_test) == (640, 160)
        # a fifth of the rows and of every quantile bin of the target
        y = np.array([float(x[LI_TARGET]) for x in li.collect()])
        edges = np.quantile(y, [0.2, 0.4, 0.6, 0.8])
        assert set(np.bincount(np.searchsorted(edges, [float(x[LI_TARGET]) for x in test]))) == {32}


def test_all_models_with_missing_features(spark, tmp_path):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(90, 2))
    y = X[:, 0] + 0.1 * rng.normal(size=90)
    df = spark.createDataFrame([(i, None if i % 11 == 0 else float(a), float("nan") if i % 13 == 0 else float(b), float(v))
                                for i, ((a, b), v) in enumerate(zip(X, y))], "id long, a double, b double, y double").coalesce(1)
    small = {"SVR_RBF": {"max_iter": 5}, "GradientBoosting": {"n_estimators": 2}, "HistGradientBoosting": {"max_iter": 2},
             "RandomForest": {"n_estimators": 3, "max_depth": 4}, "ExtraTrees": {"n_estimators": 3, "max_depth": 4}}
    table = {k: (key, {**p, **small.get(k, {})}, s) for k, (key, p, s) in batch.ROBUST_MODELS.items()}
    per = batch.robustness(df, {"all": ["a", "b"]}, "y", table, [3], ["id"], cv_folds=2)
    rows = {r.model: r for r in per.collect()}
    assert set(rows) == set(batch.ROBUST_MODELS) and all(r.n_train + r.n_test == 90 for r in rows.values())
    assert rows["LinearRegression"].test_r2 > 0.5 and rows["KNN"].test_r2 > 0.3
    # the imputer's medians are those of the training rows
    sp = split.train_test_split(split.robustness_strata(df, "y")[0], ["id"], 0.2, 3, "__stratum").collect()
    tr, te = [r for r in sp if r.split == "train"], [r for r in sp if r.split == "test"]
    ok = lambda v: v is not None and v == v
    mid = {f: np.median([r[f] for r in tr if ok(r[f])]) for f in "ab"}
    mat = lambda part: np.array([[1.0, *[r[f] if ok(r[f]) else mid[f] for f in "ab"]] for r in part])
    w = np.linalg.lstsq(mat(tr), np.array([r.y for r in tr]), rcond=None)[0]
    z = np.array([r.y for r in te])
    assert np.isclose(rows["LinearRegression"].test_r2, 1 - np.mean((z - mat(te) @ w) ** 2) / np.var(z))
    paths = batch.write_robustness(per, str(tmp_path))
    back = spark.read.option("header", True).csv(paths["per_seed_results"])
    assert back.count() == 10 and "cv_r2_sd" in back.columns
    assert spark.read.option("header", True).csv(paths["summary"]).count() == 10


def test_lasso_cv_returns_the_path_and_the_refit(spark, sf):
    rows = entry_mod.queries()["r4_lasso_cv_lineitem"](spark, sf).collect()
    assert len(rows) == 100
    best = [r for r in rows if r.best]
    assert len(best) == 1 and best[0].cv_mse == min(r.cv_mse for r in rows)
    a, y = design(spark.read.parquet(f"{sf}/lineitem.parquet").collect(), LI_FEATS)
    x, sy = a[:, 1:], y.std()
    z = (x - x.mean(0)) / x.std(0)
    w = np.array([best[0][f"coef_{f}"] for f in LI_FEATS]) * x.std(0) / sy
    pull = z.T @ ((y - y.mean()) / sy - z @ w) / len(y)  # the gradient is alpha where a coefficient isn't 0
    assert all(np.isclose(g, best[0].alpha * np.sign(c), atol=1e-7) if c else abs(g) <= best[0].alpha + 1e-9 for g, c in zip(pull, w))
    assert np.isclose(best[0].intercept, y.mean() - x.mean(0) @ (w * sy / x.std(0)))


def test_models_and_sets_of_a_seed_share_folds_and_scales(spark, monkeypatch):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(60, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(a - b + 0.1 * e)) for i, ((a, b), e) in enumerate(zip(X, rng.normal(size=60)))],
                               "id long, a double, b double, y double").coalesce(1)
    calls = {"kfold": 0, "fit_scaler": 0}
    for module, name in ((split, "kfold"), (batch.transform, "fit_scaler")):
        def counted(*args, _real=getattr(module, name), _name=name, **kw):
            calls[_name] += 1
            return _real(*args, **kw)
        monkeypatch.setattr(module, name, counted)
    sets = {"one": ["b"], "both": ["a", "b"]}
    got = batch.robustness(df, sets, "y", ["Linear", "Ridge"], [4], ["id"], cv_folds=2).collect()
    assert [(r.feature_set, r.model) for r in got] == [(s, m) for s in sets for m in ("Linear", "Ridge")]
    assert calls == {"kfold": 1, "fit_scaler": 1}


def test_a_seed_takes_a_fixed_number_of_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(80, 3))
    df = spark.createDataFrame([(i, *map(float, x), float(x @ [1, -2, 0.5] + 0.1 * e), "not read") for i, (x, e) in enumerate(zip(X, rng.normal(size=80)))],
                               "id long, a double, b double, c double, y double, text string").coalesce(2)
    calls = []
    for module, name in ((batch.linear, "moments"), (batch.metrics, "regression_scores"), (batch.metrics, "regression_metrics")):
        def counted(*args, _real=getattr(module, name), _name=name, **kw):
            calls.append(_name)
            return _real(*args, **kw)
        monkeypatch.setattr(module, name, counted)
    sets = {"two": ["c", "a"], **batch.feature_sets(["a", "b", "c"])}
    table = {"ols": ("Linear", {}, True), "ridge": ("Ridge", {"alpha": 2.0}, True), "raw": ("Ridge", {"alpha": 2.0}, False)}
    got = batch.robustness(df, sets, "y", table, [1, 2], ["id"], cv_folds=4).collect()
    assert sorted(calls) == ["moments"] * 2 + ["regression_scores"] * 4
    assert [(r.seed, r.feature_set, r.model) for r in got] == [(s, f, m) for s in (1, 2) for f in sets for m in table]
    monkeypatch.undo()
    for r in got:  # as by the passes per model, over the same rows
        sp = split.train_test_split(split.robustness_strata(df, "y")[0], ["id"], 0.2, r.seed, "__stratum")
        tr, te = sp.where("split = 'train'"), sp.where("split = 'test'")
        key, params, scaled = table[r.model]
        if r.feature_set in ("two", "all"):
            m = batch.Prepared(key, params, "standard" if scaled else "none").fit(tr, sets[r.feature_set], "y")
            want = batch.metrics.regression_metrics(m.transform(te), "y", "prediction", median=False).first()
            assert np.allclose((r.test_r2, r.rmse, r.mae), (want.r2, want.rmse, want.mae), rtol=1e-9)
