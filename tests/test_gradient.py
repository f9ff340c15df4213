import math

import numpy as np
import pytest

from quarry.operators import gradient as G
from quarry.plans import models

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = 2 * X[:, 0] - 0.3 * X[:, 1] + X[:, 2] + 0.1 * rng.normal(size=300)
    third = np.where(y > 0.5, "hi", np.where(y > -0.8, "mid", "lo"))
    rows = [(i, *map(float, x), float(v), str(c), "in" if x[0] ** 2 + ((x[1] - 3) / 5) ** 2 < 1.2 else "out")
            for i, (x, v, c) in enumerate(zip(X, y, third))]
    rows += [(900, None, 1.0, 1.0, 1.0, "hi", "in"), (901, 1.0, 1.0, 1.0, None, None, None)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, third string, ring string").persist()


def arrays(table, target="y"):
    rows = [r for r in table.collect() if r["a"] is not None and r[target] is not None]
    return np.array([[r[f] for f in FEATS] for r in rows]), np.array([r[target] for r in rows])


@pytest.mark.parametrize("key,target,params", [
    ("SGD", "y", {}), ("MLP", "y", {"hidden_layer_sizes": (7, 5), "max_iter": 8}), ("SGD_classifier", "third", {"max_iter": 8}),
    ("PassiveAggressive", "y", {"max_iter": 8}), ("Perceptron", "third", {"max_iter": 8}), ("SVM", "y", {"kernel": "poly", "max_iter": 8})])
def test_model_does_not_depend_on_partitions(table, key, target, params):
    got = [models.make(key, params).fit(table.repartition(n), FEATS, target).params for n in ((2, 16, 40) if key == "SGD" else (2, 16))]
    for other in got[1:]:
        for a, b in zip(got[0], other):
            assert np.allclose(a, b, rtol=1e-4, atol=1e-5)


def test_squared_loss_reaches_the_ridge_solution(table):
    X, y = arrays(table)
    Z, v = (X - X.mean(0)) / X.std(0), (y - y.mean()) / y.std()
    want = np.linalg.solve(Z.T @ Z + len(Z) * 0.01 * np.eye(3), Z.T @ v)
    m = models.make("SGD", {"alpha": 0.01}).fit(table, FEATS, "y")
    assert np.allclose(np.array(m.params[0])[:, 0], want, atol=1e-5)


@pytest.mark.parametrize("loss", ["squared", "hinge", "epsilon_insensitive", "squared_hinge", "softmax"])
def test_gradients_match_differences(loss):
    rng = np.random.default_rng(1)
    X, k = rng.normal(size=(20, 4)), 3
    Y = np.eye(k)[rng.integers(0, k, 20)]
    Y = Y if loss == "softmax" else 2 * Y - 1
    for hidden in ((), (5, 4)):
        params = [p + 0.1 * rng.normal(size=p.shape) for p in G.init_params(4, k, hidden, 2)]
        _, grads = G.loss_sums(params, X, Y, loss)
        flat, got = G._flat(params), G._flat(grads)
        for i in range(0, len(flat), 3):
            up, down = flat.copy(), flat.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            diff = (G.loss_sums(G._shaped(up, params), X, Y, loss)[0] - G.loss_sums(G._shaped(down, params), X, Y, loss)[0]) / 2e-6
            assert abs(diff - got[i]) < 1e-4


def plain_aggressive(Z, Y, C, steps, eps=None):
    """One example after the other: its closed-form step, then their mean."""
    k = Y.shape[1]
    w, b, best = np.zeros((Z.shape[1], k)), np.zeros(k), None
    for step in range(steps + 1):
        total, dw, db = 0.0, np.zeros_like(w), np.zeros(k)
        for x, t in zip(Z, Y):
            for j in range(k):
                f = sum(x[i] * w[i, j] for i in range(len(x))) + b[j]
                loss = max(0.0, 1 - t[j] * f) if eps is None else max(0.0, abs(f - t[j]) - eps)
                tau = min(C, loss / (sum(x * x) + 1))
                side = t[j] if eps is None else math.copysign(1.0, t[j] - f)
                dw[:, j] += tau * side * x
                db[j] += tau * side
                total += loss
        if best is None or total / len(Z) < best[0]:
            best = (total / len(Z), w.copy(), b.copy())
        w, b = w + dw / len(Z), b + db / len(Z)
    return best[1:]


def test_passive_aggressive_equals_a_plain_loop(table):
    X, y = arrays(table)
    Z = (X - X.mean(0)) / X.std(0)
    m = models.make("PassiveAggressive", {"C": 0.05, "max_iter": 12}).fit(table, FEATS, "y")
    w, b = plain_aggressive(Z, ((y - y.mean()) / y.std())[:, None], 0.05, 12, 0.1)
    assert np.allclose(m.params[0], w) and np.allclose(m.params[1], b)
    X, t = arrays(table, "third")
    Z = (X - X.mean(0)) / X.std(0)
    m = models.make("PassiveAggressive_classifier", {"max_iter": 12}).fit(table, FEATS, "third")
    w, b = plain_aggressive(Z, np.array([[1.0 if v == c else -1.0 for c in m.classes] for v in t]), 1.0, 12)
    assert np.allclose(m.params[0], w) and np.allclose(m.params[1], b)
    assert w.any()


def test_kernel_maps_near_their_kernels():
    rng = np.random.default_rng(3)
    Z = rng.normal(size=(40, 3))
    assert (G.feature_map("linear", 3)(Z) == Z).all()
    exact = (0.5 * Z @ Z.T + 1.0) ** 3
    errors = []
    for size in (64, 4096):
        runs = [G.feature_map("poly", 3, size, 0.5, 3, 1.0, seed)(Z) for seed in range(8)]
        gram = [P @ P.T for P in runs]
        assert np.allclose(np.mean(gram, axis=0), exact, atol=0.6 * np.abs(exact).max())
        errors.append(np.mean([np.abs(g - exact).mean() for g in gram]))
    assert errors[1] < 0.35 * errors[0]
    P = G.feature_map("rbf", 3, 20000, 0.3)(Z)
    d2 = ((Z[:, None] - Z[None]) ** 2).sum(-1)
    assert np.abs(P @ P.T - np.exp(-0.3 * d2)).max() < 0.05
    with pytest.raises(ValueError):
        G.feature_map("sigmoid", 3)


def test_polynomial_kernel_separates_a_ring_and_a_linear_one_does_not(table):
    table = table.coalesce(1).persist()

    def right(**kw):
        out = models.make("SVC_classifier", {"C": 100.0, "max_iter": 30, **kw}).fit(table, FEATS, "ring").transform(table.where("ring IS NOT NULL AND a IS NOT NULL"))
        rows = out.select("ring", "prediction").collect()
        return sum(r["ring"] == r["prediction"] for r in rows) / len(rows)
    assert right(kernel="poly", degree=2, coef0=1.0, n_components=128) > 0.95
    assert right(kernel="rbf", gamma=0.5) > 0.9
    assert right(kernel="linear") < 0.85


def test_missing_rows_and_empty_tables(table):
    m = models.make("SGD_classifier", {"max_iter": 5}).fit(table, FEATS, "third")
    got = {r["id"]: r["prediction"] for r in m.transform(table).collect()}
    assert got[900] is None and got[901] is not None
    with pytest.raises(ValueError):
        models.make("SGD").fit(table.where("false"), FEATS, "y")
