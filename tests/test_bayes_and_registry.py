import numpy as np

from quarry.operators import bayes
from quarry.plans import models


def test_gaussian_nb_vs_numpy(spark):
    rng = np.random.default_rng(8)
    X = np.vstack([rng.normal(0, 1, (40, 2)), rng.normal(2, 0.5, (20, 2))])
    y = np.array(["a"] * 40 + ["b"] * 20)
    df = spark.createDataFrame([(float(p), float(q), c) for (p, q), c in zip(X, y)], "p double, q double, y string")
    m = bayes.fit_gaussian_nb(df, ["p", "q"], "y")
    out = m.transform(df).select("prediction", "prob_a").collect()
    eps = 1e-9 * X.var(0).max()
    jll = []
    for c in ("a", "b"):
        Xc = X[y == c]
        mu, var = Xc.mean(0), Xc.var(0) + eps
        jll.append(np.log(len(Xc) / len(X)) - 0.5 * np.log(2 * np.pi * var).sum()
                   - 0.5 * ((X - mu) ** 2 / var).sum(1))
    jll = np.array(jll).T
    pa = np.exp(jll[:, 0] - jll.max(1)) / np.exp(jll - jll.max(1, keepdims=True)).sum(1)
    assert np.allclose([r["prob_a"] for r in out], pa)
    assert [r["prediction"] for r in out] == list(np.where(jll[:, 0] >= jll[:, 1], "a", "b"))


def test_registry_size():
    known = [*models.REGRESSION, *models.CLASSIFICATION, *models.CLUSTERING, *models.UNSUPPORTED]
    assert len(known) >= 69
    assert sum(models.problem_type(k) == "cluster" for k in known) >= 12
    assert models.problem_type("Linear") == "regression"
    assert models.problem_type("RF_classifier") == "classification"
    assert models.problem_type("kmeans") == "cluster"
