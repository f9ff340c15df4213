import numpy as np
import pytest

from quarry.operators import linear


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 3)) * [1.0, 5.0, 0.1]
    y = X @ [2.0, -1.0, 30.0] + 4 + rng.normal(scale=0.5, size=300)
    rows = [tuple(map(float, r)) + (float(v),) for r, v in zip(X, y)]
    return X, y, spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(5)


def test_ols_matches_lstsq(data):
    X, y, df = data
    m = linear.fit(df, ["a", "b", "c"], "y", "ols")
    A = np.column_stack([np.ones(len(X)), X])
    ref = np.linalg.lstsq(A, y, rcond=None)[0]
    assert np.allclose(m.coef, ref[1:], atol=1e-8) and abs(m.intercept - ref[0]) < 1e-8


def test_ridge_closed_form_on_standardised(data):
    X, y, df = data
    m = linear.fit(df, ["a", "b", "c"], "y", "ridge", alpha=3.0)
    Z = (X - X.mean(0)) / X.std(0)
    ys = (y - y.mean()) / y.std()
    w = np.linalg.solve(Z.T @ Z + 3.0 * np.eye(3), Z.T @ ys)
    assert np.allclose(m.coef, w * y.std() / X.std(0), atol=1e-8)


def test_lasso_kkt(data):
    X, y, df = data
    alpha = 0.05
    m = linear.fit(df, ["a", "b", "c"], "y", "lasso", alpha=alpha)
    Z = (X - X.mean(0)) / X.std(0)
    ys = (y - y.mean()) / y.std()
    w = m.coef * X.std(0) / y.std()
    g = Z.T @ (ys - Z @ w) / len(y)
    for gj, wj in zip(g, w):  # KKT of 1/(2n)|r|^2 + alpha |w|_1
        if wj != 0:
            assert abs(gj - alpha * np.sign(wj)) < 1e-3
        else:
            assert abs(gj) <= alpha + 1e-3


def test_moments_combine_minus(spark, data):
    X, y, df = data
    from pyspark.sql import functions as F
    g = df.withColumn("g", (F.col("a") > 0).cast("int"))
    parts = linear.moments(g, ["a", "b", "y"], group="g")
    total = linear.moments(g, ["a", "b", "y"])[None]
    comb = parts[0].combine(parts[1])
    assert np.allclose(comb.C, total.C) and np.allclose(comb.mean, total.mean)
    back = total.minus(parts[0])
    assert np.allclose(back.C, parts[1].C, atol=1e-6) and np.isclose(back.n, parts[1].n)


def test_heldout_mse_from_moments(spark, data):
    X, y, df = data
    mo = linear.moments(df, ["a", "b", "c", "y"])[None]
    coef, b = np.array([1.0, 0.5, -2.0]), 0.3
    direct = np.mean((y - b - X @ coef) ** 2)
    assert np.isclose(linear.heldout_mse(mo, coef, b, 3), direct)


def test_lars_endpoint_is_ols(data):
    X, y, df = data
    mo = linear.moments(df, ["a", "b", "c", "y"])[None]
    c_l, b_l, _ = linear.solve(mo, 3, "lars")
    c_o, b_o, _ = linear.solve(mo, 3, "ols")
    assert np.allclose(c_l, c_o, rtol=1e-6, atol=1e-8)


def test_constant_feature_does_not_fail(spark):
    df = spark.createDataFrame([(1.0, float(i), 2.0 * i) for i in range(20)], "k double, x double, y double")
    m = linear.fit(df, ["k", "x"], "y", "ols")
    assert abs(m.coef[1] - 2.0) < 1e-9


def test_wide_moments_match_narrow(spark):
    rng = np.random.default_rng(12)
    X = rng.normal(size=(200, 4)) * [1, 10, 100, 0.01] + [5, -3, 1000, 0]
    df = spark.createDataFrame([tuple(map(float, r)) + (int(i % 3),) for i, r in enumerate(X)],
                               "a double, b double, c double, d double, g int").repartition(6)
    narrow = linear.moments(df, ["a", "b", "c", "d"], group="g")
    wide = linear._moments_wide(df, ["a", "b", "c", "d"], "g")
    for g, mo in narrow.items():
        w = wide[str(g)]
        assert np.isclose(w.n, mo.n) and np.allclose(w.mean, mo.mean) and np.allclose(w.C, mo.C, rtol=1e-8)
