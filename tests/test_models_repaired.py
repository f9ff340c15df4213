import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import cluster, explain, linear, outliers, select, transform
from quarry.plans import models, tune

SMALL = {"n_estimators": 3, "max_depth": 3}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(240, 3))
    y = 2 * X[:, 0] - X[:, 1] + 0.1 * rng.normal(size=240)
    rows = [(*map(float, x), float(v), "hi" if v > 0 else "lo", i) for i, (x, v) in enumerate(zip(X, y))]
    rows += [rows[0][:5] + (900,), rows[0][:5] + (901,)]  # equal rows
    return spark.createDataFrame(rows, "a double, b double, c double, y double, label string, id long").persist()


FEATS = ["a", "b", "c"]


def small(key):
    names = models.parameters(key)
    out = {k: v for k, v in SMALL.items() if k in names}
    if "max_iter" in names:
        out["max_iter"] = 5
    if "n_trials" in names:
        out["n_trials"] = 50
    return out


@pytest.mark.parametrize("key", sorted([*models.REGRESSION, *models.CLASSIFICATION]))
def test_every_key_fits_and_scores(table, key):
    task = models.problem_type(key)
    df = table
    if "NB_" in key:
        df = table.select(*[F.floor((F.col(f) + 5) * 2).cast("double").alias(f) for f in FEATS], "y", "label")
    target = "label" if task == "classification" or key == "Perceptron" else "y"
    if key == "Perceptron":
        df = df.withColumn("label", F.col("label"))
    out = models.make(key, small(key)).fit(df, FEATS, target).transform(df)
    assert out.where(F.col("prediction").isNotNull()).count() >= 200
    assert out.count() == df.count()


@pytest.mark.parametrize("key", ["Linear", "SGD", "SVM", "MLP_classifier", "PassiveAggressive", "AdaBoost", "AdaBoost_classifier", "K-Nearest",
                                 "KNeighbors_classifier", "RadiusNeighbors", "Polynomial", "ExtraTrees", "HistGradientBoosting_classifier",
                                 "RF_classifier", "GaussianNB_classifier", "Quantile"])
def test_saved_models_score_alike(spark, table, key, tmp_path):
    from quarry.sources.sinks import load_model, save_model
    target = "label" if models.problem_type(key) == "classification" else "y"
    m = models.make(key, small(key)).fit(table, FEATS, target)
    save_model(spark, m, f"{tmp_path}/m")
    back = load_model(spark, f"{tmp_path}/m")
    short = lambda v: round(v, 9) if isinstance(v, float) else v
    got = [sorted((r["id"], short(r["prediction"])) for r in x.transform(table).collect()) for x in (m, back)]
    assert got[0] == got[1] and any(v is not None for _, v in got[0])


def test_isolation_forest_is_saved(spark, table, tmp_path):
    from quarry.operators.isolation import fit_isolation_forest
    from quarry.sources.sinks import load_model, save_model
    m = fit_isolation_forest(table, FEATS, ["id"], n_trees=5)
    save_model(spark, m, f"{tmp_path}/m")
    got = [sorted((r["id"], r["if_score"], r["inlier"]) for r in x.transform(table).collect()) for x in (m, load_model(spark, f"{tmp_path}/m"))]
    assert got[0] == got[1]
    with pytest.raises(TypeError):
        save_model(spark, object(), f"{tmp_path}/o")


def test_unsupported_and_unknown(table):
    for key in models.UNSUPPORTED:
        with pytest.raises(NotImplementedError):
            models.make(key)
    with pytest.raises(ValueError, match="alpha"):
        models.make("Ridge", {"alfa": 1})
    with pytest.raises(ValueError):
        transform.fit_scaler(table, FEATS, "fancy")


def test_ridge_positive_keeps_its_penalty(table):
    mo = linear.moments(table, [*FEATS, "y"])[None]
    w = [linear.solve(mo, 3, "ridge", alpha=a, positive=True)[0] for a in (1e-9, 500.0)]
    assert (w[1] >= 0).all() and w[1][0] < 0.6 * w[0][0]


def test_parameters_reach_the_model(table):
    near = models.make("K-Nearest", {"n_neighbors": 1}).fit(table, FEATS, "y").transform(table)
    assert near.where(F.abs(F.col("prediction") - F.col("y")) > 1e-9).count() == 0
    flat = models.make("Ridge", {"alpha": 1e9}).fit(table, FEATS, "y")
    assert np.abs(flat.coef).max() < 1e-3


def test_lars_cv_runs_its_own_path(table):
    m = models.make("LassoLarsCV").fit(table, FEATS, "y")
    assert m.info["alpha"] == min(m.info["cv_mse"], key=lambda a: (m.info["cv_mse"][a], a))
    assert abs(m.coef[0] - 2) < 0.1 and abs(m.coef[2]) < 0.05
    assert abs(models.make("LARSCV").fit(table, FEATS, "y").coef[1] + 1) < 0.1


def test_cv_kinds_differ_and_scalers_count(table):
    def rows(**kw):
        return [tuple(r) for r in tune.cross_validate(table, FEATS, "y", kw.pop("model", "Linear"), ["id"], 3, **kw)[0].collect()]
    assert [len(rows(kind=k)) for k in ("KFold", "RepeatedKFold", "ShuffleSplit")] == [3, 6, 3]
    assert rows(kind="KFold") == rows(kind="RepeatedKFold")[:3] != rows(kind="ShuffleSplit")
    strong = {"alpha": 300.0}
    by = {s: rows(model="Ridge", scaler=s, params=strong) for s in ("standard", "none", "minmax")}
    assert by["standard"] != by["none"] and by["minmax"] != by["standard"]
    # moments and row-wise scaling are the same model
    wide = rows(model="Ridge", scaler="standard", params=strong)
    one_by_one = rows(model="Ridge", scaler="standard", factory=lambda: models.make("Ridge", strong, prescaled=True))
    assert np.allclose(wide, one_by_one)
    y = rows(model="Lasso", scaler="standard", y_scaler="standard", params={"alpha": 0.05})
    assert not np.allclose(y, rows(model="Lasso", scaler="standard", params={"alpha": 0.05}))


def test_search_scores_by_squared_error_and_refits(table):
    grid = {"alpha": [0.001, 1.0, 1000.0, 1e5]}
    for how in ("grid", "bayes"):
        res, best, m = tune.search(table, FEATS, "y", "Ridge", grid, key_cols=["id"], k=3, how=how, n_iter=4, refit=True)
        scores = {r["params"]: r["score"] for r in res.collect()}
        assert best == {"alpha": 0.001} and all(s < 0 for s in scores.values()) and len(scores) == 4
        assert abs(m.coef[0] - 2) < 0.1


def test_agglomerative_merges_micro_clusters(spark):
    rng = np.random.default_rng(1)
    # two long thin strips: k-means with k = 2 cuts across them, ward on micro-clusters too may not,
    # so compare with the ward merge of the rows themselves
    pts = np.concatenate([rng.normal([0, 0], 0.2, (20, 2)), rng.normal([6, 0], 0.2, (20, 2)), rng.normal([0, 6], 0.2, (3, 2))])
    df = spark.createDataFrame([(i, float(x), float(z)) for i, (x, z) in enumerate(pts)], "id int, x double, z double")
    got = {r.id: r.cluster for r in cluster.agglomerative(df, ["x", "z"], 3).transform(df).collect()}
    want = cluster._ward_merge(pts, np.ones(len(pts)), 3)
    pairs = {(got[i], int(want[i])) for i in range(len(pts))}
    assert len(pairs) == 3


def test_shapley_of_a_linear_model(table):
    m = linear.fit(table, FEATS, "y")
    got = {r.feature: r.mean_abs_shap for r in explain.kernel_shap(m, table, FEATS, ["id"], None).collect()}
    X = np.array([[r.a, r.b, r.c] for r in table.collect()])
    exact = np.abs(m.coef * (X - X.mean(axis=0))).mean(axis=0)
    assert np.allclose([got[f] for f in FEATS], exact)
    assert len(explain.kernel_shap(m, table, FEATS, ["id"], 10).collect()) == 3


def test_shapley_values_match_their_definition(table, spark):
    class Bent:
        def transform(self, df):
            return df.withColumn("prediction", F.col("a") * F.col("b") + F.abs(F.col("c")) + 2 * F.col("d"))
    names = ["a", "b", "c", "d"]
    rng = np.random.default_rng(3)
    X, B = rng.normal(size=(6, 4)), rng.normal(size=(5, 4))
    w = np.array([0.1, 0.2, 0.3, 0.3, 0.1])
    f = lambda x: x[..., 0] * x[..., 1] + np.abs(x[..., 2]) + 2 * x[..., 3]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "id long, a double, b double, c double, d double")
    got = {r["id"]: r for r in explain.shap_values(Bent(), df, names, ["id"], B.tolist(), w.tolist()).collect()}

    def value(x, s):
        return (w * f(np.where(np.isin(np.arange(4), s), x, B))).sum()
    for i, x in enumerate(X):
        want = np.zeros(4)
        for order in itertools.permutations(range(4)):
            for k, j in enumerate(order):
                want[j] += (value(x, order[:k + 1]) - value(x, order[:k])) / 24
        assert np.allclose([got[i][f"shap_{n}"] for n in names], want)
    # drawn coalitions still add up to the prediction
    drawn = explain.shap_values(Bent(), df, names, ["id"], B.tolist(), w.tolist(), n_samples=10).collect()
    assert np.allclose([sum(r[f"shap_{n}"] for n in names) for r in drawn], [f(X[r["id"]]) - (w * f(B)).sum() for r in drawn])
    one = explain.shap_values(linear.fit(table, ["a"], "y"), table.limit(3), ["a"], ["id"], [[0.0]], [1.0]).collect()
    assert len(one) == 3


def test_pca_signs_and_centers(table):
    out, ratio = explain.pca2(table, FEATS)
    X = np.array([[r.a, r.b, r.c] for r in table.collect()])
    _, s, V = np.linalg.svd(X - X.mean(0), full_matrices=False)
    V = V * np.sign(V[np.arange(3), np.abs(V).argmax(1)])[:, None]
    got = np.array([[r.pc1, r.pc2] for r in out.collect()])
    assert np.allclose(got, (X - X.mean(0)) @ V[:2].T) and np.allclose(ratio, (s ** 2 / (s ** 2).sum())[:2])
    m = explain.fit_pca(table, FEATS)
    assert np.allclose(m.project(X[:2]), got[:2])


def test_spectral_separates_two_rings(spark):
    rng = np.random.default_rng(6)
    turn = np.concatenate([np.linspace(0, 2 * np.pi, 90, endpoint=False), np.linspace(0, 2 * np.pi, 150, endpoint=False)])
    far = np.where(np.arange(240) < 90, 1.0, 3.0) + rng.normal(0, 0.08, 240)
    df = spark.createDataFrame([(i, float(r * np.cos(a)), float(r * np.sin(a))) for i, (a, r) in enumerate(zip(turn, far))],
                               "id long, x double, z double")
    got = {r["id"]: r["cluster"] for r in cluster.spectral(df, "id", ["x", "z"], 2, 6).collect()}
    assert len({got[i] for i in range(90)}) == len({got[i] for i in range(90, 240)}) == 1 and got[0] != got[239]


def test_leading_vectors_match_numpy(spark):
    rng = np.random.default_rng(7)
    A = rng.normal(size=(50, 50)) * (rng.random((50, 50)) < 0.2)
    A = A + A.T + np.diag(np.linspace(0, 8, 50))
    edges = spark.createDataFrame([(int(i), int(j), float(A[i, j])) for i, j in zip(*np.nonzero(A))], "src long, dst long, w double")
    start = spark.createDataFrame([(i, 1.0) for i in range(50)], "id long, one double")
    vectors, values = cluster.leading_vectors(edges, start, "one", 3, blocks=5)
    vals, vecs = np.linalg.eigh(A)
    assert np.allclose(values, vals[::-1][:3], atol=1e-6)
    U = np.array([[r[f"u{j}"] for j in range(3)] for r in vectors.orderBy("id").collect()])
    assert np.allclose(np.abs((U * vecs[:, ::-1][:, :3]).sum(0)), 1, atol=1e-4)


def test_lof_keeps_equal_rows_apart(table):
    df = table.withColumn("split", F.lit("train"))
    out, info = outliers.handle(df, FEATS, "split", "LocalOutlierFactor", "remove")
    row = info.first()
    assert row["original"] == df.count() and row["remaining"] == out.count()
    assert 0 < row["outliers"] <= 0.15 * df.count()


def test_f_scores_use_paired_rows(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=60), rng.normal(size=60)
    y += x
    rows = [(None if i % 4 == 0 else float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    got = select.f_regression(spark.createDataFrame(rows, "x double, y double"), ["x"], "y").first()["score"]
    keep = np.arange(60) % 4 != 0
    r = np.corrcoef(x[keep], y[keep])[0, 1]
    assert abs(got - r * r / (1 - r * r) * (keep.sum() - 2)) < 1e-9


def test_birch_and_mean_shift_on_blobs(spark):
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal([0, 0], 0.3, (60, 2)), rng.normal([5, 5], 0.3, (40, 2))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "x double, z double")
    for m in (cluster.birch(df, ["x", "z"], 2, threshold=0.2), cluster.mean_shift(df, ["x", "z"], 1.5)):
        got = [r.cluster for r in m.transform(df).collect()]
        assert len(set(got[:60])) == len(set(got[60:])) == 1 and got[0] != got[-1]
    with pytest.raises(ValueError):
        cluster.mean_shift(df, ["x", "z"], 1.5, min_bin_freq=1000)


def test_confusion_grid_is_full_at_any_size(spark):
    from quarry.operators import metrics
    names = [f"c{k:04d}" for k in range(1100)]
    df = spark.createDataFrame([("c0001", "c0002"), ("c0001", "c0001"), ("c1099", "c0000")], "y string, p string")
    got = metrics.confusion_counts(df, "y", "p", names)
    assert got.count() == len(names) ** 2
    assert sorted(tuple(r) for r in got.where("count > 0").select("actual", "predicted", "count").collect()) == [
        ("c0001", "c0001", 1), ("c0001", "c0002", 1), ("c1099", "c0000", 1)]


def test_partial_dependence_of_expressions_and_of_any_model(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=120), "b": rng.integers(0, 4, 120).astype(float), "id": range(120)})
    pdf["y"] = 2 * pdf.a - pdf.b
    df = spark.createDataFrame(pdf)
    m = linear.LinearModel(["a", "b"], np.array([2.0, -1.0]), 0.5, "y")

    class Opaque:  # no expression to force a value in
        features = ["a", "b"]

        def transform(self, d):
            return d.withColumn("prediction", F.col("a") * F.col("a") * F.col("b"))

    lo, hi = np.quantile(pdf.b, [0.05, 0.95])
    want = {g: 2 * pdf.a.mean() - g + 0.5 for g in np.linspace(lo, hi, 7)}
    got = {r["value"]: r["mean_prediction"] for r in explain.partial_dependence(m, df, "b", 7).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)
    got = {r["value"]: r["mean_prediction"] for r in explain.partial_dependence(Opaque(), df, "a", 5).collect()}
    assert len(got) == 5 and all(abs(v - g * g * pdf.b.mean()) < 1e-9 for g, v in got.items())
    assert explain.partial_dependence(m, df.limit(0), "b", 7).count() == 0
