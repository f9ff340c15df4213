import math

import numpy as np
import pytest

from quarry.operators import trees as T
from quarry.plans import models

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    X = np.column_stack([rng.integers(0, 30, 400) / 3, rng.integers(0, 6, 400), rng.integers(0, 100, 400)]).astype(float)
    y = np.where(X[:, 0] > 4, 3.0, -1.0) + X[:, 1] * (X[:, 2] > 50) + rng.integers(-2, 3, 400)
    return X, y


@pytest.fixture(scope="module")
def table(spark, data):
    X, y = data
    rows = [(i, *map(float, x), float(v), "lo" if v < 0 else "mid" if v < 4 else "hi", "yes" if v > 2 else "no") for i, (x, v) in enumerate(zip(X, y))]
    rows += [(900, None, 1.0, 1.0, 1.0, "hi", "no"), (901, 1.0, 1.0, 1.0, None, None, None)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, third string, two string").persist()


def brute_best_first(X, r, max_leaves, min_leaf):
    """Best-first tree of squared error on residuals; the splits in the order made."""
    def best(rows):
        out = (-math.inf,)
        for f in range(X.shape[1]):
            values = np.unique(X[:, f])
            for t in (values[:-1] + values[1:]) / 2:
                left = rows[X[rows, f] <= t]
                right = rows[X[rows, f] > t]
                if min(len(left), len(right)) < min_leaf:
                    continue
                gain = r[left].sum() ** 2 / len(left) + r[right].sum() ** 2 / len(right) - r[rows].sum() ** 2 / len(rows)
                if gain > out[0] * (1 + 1e-9) + 1e-12:
                    out = (gain, f, t, left, right)
        return out
    queue, made = [best(np.arange(len(X)))], []
    leaves = [np.arange(len(X))]
    while len(made) < max_leaves - 1:
        k = max(range(len(queue)), key=lambda i: queue[i][0])
        gain, *rest = queue.pop(k)
        if gain <= 1e-10:
            break
        f, t, left, right = rest
        rows = leaves.pop(k)
        made.append((f, t, len(rows)))
        for part in (left, right):
            leaves.append(part)
            queue.append(best(part))
    return made, leaves


@pytest.mark.parametrize("max_leaves,min_leaf", [(31, 20), (6, 1)])
def test_first_boosted_tree_is_the_best_first_tree(table, data, max_leaves, min_leaf):
    X, y = data
    m = models.make("HistGradientBoosting", {"max_iter": 1, "learning_rate": 0.5, "max_leaf_nodes": max_leaves, "min_samples_leaf": min_leaf}).fit(table, FEATS, "y")
    used = np.vstack([X, [1.0, 1.0, 1.0]])[:len(X)]
    made, leaves = brute_best_first(used, y - y.mean(), max_leaves, min_leaf)
    tree = m.trees[0]
    assert sorted((f, round(t, 9)) for f, t in zip(tree["feature"], tree["threshold"]) if f >= 0) == sorted((f, round(t, 9)) for f, t, _ in made)
    want = np.zeros(len(X))
    for rows in leaves:
        want[rows] = y.mean() + 0.5 * (y[rows].mean() - y.mean())
    assert np.allclose(m.scores(X)[:, 0], want)


def test_boosting_lowers_the_loss_and_stays_the_same_at_any_partitioning(table, data, monkeypatch):
    monkeypatch.setattr(T, "REWRITE", 2)
    X, y = data
    params = {"max_iter": 5, "max_leaf_nodes": 8, "min_samples_leaf": 5}
    one, two = (models.make("HistGradientBoosting", params).fit(table.repartition(n), FEATS, "y") for n in (2, 9))
    assert np.allclose(one.scores(X), two.scores(X))
    assert all(a > b for a, b in zip(one.info["loss"], one.info["loss"][1:])) and len(one.info["loss"]) == 6
    assert abs(one.info["loss"][-1] - 0.5 * ((one.scores(X)[:, 0] - y) ** 2).mean()) < 1e-9
    small = models.make("HistGradientBoosting", params)
    monkeypatch.setattr(T, "CELLS", 255 * 3 * 3)  # a node a pass
    assert np.allclose(small.fit(table, FEATS, "y").scores(X), one.scores(X))


@pytest.mark.parametrize("key", ["GradientBoosting_classifier", "HistGradientBoosting_classifier"])
@pytest.mark.parametrize("target", ["third", "two"])
def test_softmax_boosting(table, key, target):
    params = {"max_depth": 3, "learning_rate": 0.3, "n_estimators" if key.startswith("Grad") else "max_iter": 4}
    m = models.make(key, params).fit(table, FEATS, target)
    assert len(m.trees) == 4 * (3 if target == "third" else 1)
    assert all(a > b for a, b in zip(m.info["loss"], m.info["loss"][1:]))
    rows = m.transform(table).collect()
    good = [r for r in rows if r["id"] < 900]
    for r in good:
        p = [r[f"prob_{c}"] for c in m.classes]
        assert abs(sum(p) - 1) < 1e-9 and m.classes[int(np.argmax(p))] == r["prediction"]
    assert sum(r["prediction"] == r[target] for r in good) > 0.7 * len(good)
    assert [r["prediction"] for r in rows if r["id"] == 900] == [None]


def test_extra_trees_draw_thresholds_within_each_node(table, data, monkeypatch):
    X, y = data
    params = {"n_estimators": 6, "max_depth": 4}
    one = models.make("ExtraTrees", params).fit(table.repartition(2), FEATS, "y")
    monkeypatch.setattr(T, "CELLS", 40)  # a few nodes a pass
    two = models.make("ExtraTrees", params).fit(table.repartition(9), FEATS, "y")
    assert [t["feature"] for t in one.trees] == [t["feature"] for t in two.trees]
    assert np.allclose([v for t in one.trees for v in t["threshold"]], [v for t in two.trees for v in t["threshold"]])
    assert len({tuple(t["threshold"]) for t in one.trees}) == 6
    for t in one.trees:
        # each split lies within the range of its node's rows, and values are means of its rows
        where = {0: np.arange(len(X))}
        for node, (f, cut, left) in enumerate(zip(t["feature"], t["threshold"], t["left"])):
            rows = where[node]
            assert abs(t["value"][node] - y[rows].mean()) < 1e-9
            if f >= 0:
                assert X[rows, f].min() <= cut < X[rows, f].max()
                where[left], where[left + 1] = rows[X[rows, f] <= cut], rows[X[rows, f] > cut]
    # the root's split is the best of the drawn ones
    t = one.trees[0]
    cuts = [X[:, f].min() + T.draw(42, 0, 0, f) * (X[:, f].max() - X[:, f].min()) for f in range(3)]
    gains = [sum(y[s].sum() ** 2 / s.sum() for s in (X[:, f] <= c, X[:, f] > c)) for f, c in enumerate(cuts)]
    assert t["feature"][0] == int(np.argmax(gains)) and abs(t["threshold"][0] - cuts[t["feature"][0]]) < 1e-12


def test_extra_trees_classes_and_limits(table, data):
    X, y = data
    m = models.make("ExtraTrees_classifier", {"n_estimators": 8, "max_depth": 8, "max_features": 2}).fit(table, FEATS, "third")
    rows = [r for r in m.transform(table).collect() if r["id"] < 900]
    assert sum(r["prediction"] == r["third"] for r in rows) > 0.8 * len(rows)
    assert all(abs(r["prob_lo"] + r["prob_mid"] + r["prob_hi"] - 1) < 1e-9 for r in rows)
    big = models.make("ExtraTrees", {"n_estimators": 2, "min_samples_leaf": 60}).fit(table, FEATS, "y")
    for t in big.trees:
        at = T.leaves(T.arrays_of(t), X)
        assert np.bincount(at)[np.unique(at)].min() >= 60
    with pytest.raises(ValueError):
        models.make("ExtraTrees", {"n_estimators": 1}).fit(table.where("false"), FEATS, "y")


def test_criterion_and_smallest_leaf_of_forests(table):
    one = models.make("DecisionTree_classifier", {"criterion": "entropy", "min_samples_leaf": 390}).fit(table.where("id < 900"), FEATS, "third")
    assert len({r["prediction"] for r in one.transform(table.where("id < 900")).collect()}) == 1
    with pytest.raises(ValueError):
        models.make("RF", {"criterion": "gini"}).fit(table, FEATS, "y")


def test_blocks_hold_every_row_and_find_its_leaf(spark, data, monkeypatch):
    """Boosting passes read packed blocks with the scores so far; rows don't travel again."""
    X, y = data
    monkeypatch.setattr(T, "BLOCK", 64)
    rows = spark.createDataFrame([(*map(float, x), float(v)) for x, v in zip(X, y)], "f0 double, f1 double, f2 double, y double")
    blocks = T.packed(rows, 3).collect()
    assert 1 < len(blocks) <= 16
    got = np.vstack([np.column_stack((np.frombuffer(bytes(b["x"])).reshape(3, -1).T, np.frombuffer(bytes(b["y"])))) for b in blocks])
    assert sorted(map(tuple, got)) == sorted(map(tuple, np.column_stack((X, y))))
    tree = T.stump(0.0)
    T.grow(tree, T.grow(tree, 0, 1, 2.0, (0.0, 0.0))[1], 0, 4.0, (0.0, 0.0))
    arrays = T.arrays_of(tree)
    at = T.leaves(arrays, X)
    for wanted in ({1, 3, 4}, {3}, {0}):
        found = dict(T.rows_of(arrays, np.ascontiguousarray(X.T), wanted))
        assert all(sorted(found[w]) == (list(range(len(X))) if w == 0 else np.flatnonzero(at == w).tolist()) for w in wanted)


def test_open_nodes_are_worked_by_their_rows(spark, monkeypatch):
    """Shallow trees need no expansion to a row per tree; deep ones give the same trees either way."""
    rng = np.random.default_rng(31)
    X = rng.normal(size=(700, 3))
    y = X[:, 0] * 2 + np.abs(X[:, 1])
    df = spark.createDataFrame([(*map(float, x), float(t), "ab"[int(t > 1)]) for x, t in zip(X, y)], "a double, b double, c double, y double, l string")
    for target, task in (("y", "regression"), ("l", "classification")):
        got = []
        for size in (0, 64, 1 << 30):  # by node, mixed, by piece
            monkeypatch.setattr(T, "NODE_ROWS", size)
            got.append(T.extra_trees(df.repartition(2), ["a", "b", "c"], target, task, 3, max_depth=5).trees)
        for other in got[1:]:
            for a, b in zip(got[0], other):
                assert a["feature"] == b["feature"] and a["left"] == b["left"] and a["threshold"] == b["threshold"]
                assert np.allclose(np.array(a["value"]), np.array(b["value"]), rtol=1e-9)
    tree = T.arrays_of({"feature": [0, -1, -1], "threshold": [0.0, 0.0, 0.0], "left": [1, -1, -1], "value": [0.0, 0.0, 0.0]})
    monkeypatch.setattr(T, "NODE_ROWS", 64)
    monkeypatch.setattr(T, "_open_rows", None)
    nodes = dict(T._open_nodes([tree, tree], [np.array([-1, 0, 1]), np.array([-1, -1, 2])], X.T))
    assert {i: len(r) for i, r in nodes.items()} == {0: (X[:, 0] <= 0).sum(), 1: (X[:, 0] > 0).sum(), 2: (X[:, 0] > 0).sum()}
    assert T._many_open([tree], [np.array([-1, 0, 1])], 700) == ([], [])
