import numpy as np

from quarry.operators import kendall


def _brute(x, y):
    n = len(x)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i + 1, n))
    n0 = n * (n - 1) / 2
    tie = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    return s / np.sqrt((n0 - tie(x)) * (n0 - tie(y)))


def test_s_pairs_small():
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 5, 60).astype(float), rng.integers(0, 4, 60).astype(float)
    want = sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i in range(60) for j in range(i + 1, 60))
    assert kendall.s_pairs(a, b) == want


def test_kendall_pair_vs_brute_force_with_heavy_ties(spark):
    rng = np.random.default_rng(10)
    x = np.round(rng.normal(size=300), 1)
    x[:100] = 0.5  # a third of the rows on one value
    y = np.round(x + rng.normal(size=300), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(4)
    got = kendall.kendall_pair(df, "x", "y", n_slabs=8, slab_rows=100)
    assert np.isclose(got, _brute(x, y))


def test_inversions():
    rng = np.random.default_rng(12)
    for n in (0, 1, 2, 7, 100):
        b = rng.integers(0, 20, n).astype(float)
        assert kendall._inversions(b) == sum(b[i] > b[j] for i in range(n) for j in range(i + 1, n))


def test_slabs_split_again_until_they_are_small(spark):
    rng = np.random.default_rng(13)
    x = np.exp(3 * rng.normal(size=500))  # long tail
    x[:150] = 1.0
    y = np.where(rng.random(500) < 0.3, 2.0, np.round(np.log(x) + rng.normal(size=500), 1))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(4)
    for slabs, rows in ((3, 20), (6, 40), (256, 10)):  # several rounds each
        assert np.isclose(kendall.kendall_pair(df, "x", "y", slabs, rows), _brute(x, y))
    same = spark.createDataFrame([(1.0, 2.0)] * 60, "x double, y double")
    assert kendall.kendall_pair(same, "x", "y", 3, 5) is None


def test_isolation_forest_flags_far_points(spark):
    from quarry.operators.isolation import fit_isolation_forest
    rng = np.random.default_rng(11)
    X = np.vstack([rng.normal(0, 1, (500, 2)), [[9, 9], [-9, 8], [10, -9]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "id long, x double, y double")
    m = fit_isolation_forest(df, ["x", "y"], ["id"], n_trees=50, contamination=0.1)
    out = {r["id"]: r["inlier"] for r in m.transform(df).collect()}
    assert not out[500] and not out[501] and not out[502]
    share = sum(1 for v in out.values() if not v) / len(out)
    assert 0.05 < share < 0.15


def test_isolation_paths_cost_a_tree_not_a_row(monkeypatch):
    """Leaves' lengths are worked out once a tree; every row walks to its own leaf."""
    import numpy as np
    from quarry.operators import isolation as I
    rng = np.random.default_rng(3)
    X = rng.normal(size=(2000, 3))
    X[0, 1] = np.nan
    feat, thr, left, right, size = I._grow(X[1:200], rng, 6)
    calls, plain = [], I.c_factor
    monkeypatch.setattr(I, "c_factor", lambda n: calls.append(n) or plain(n))
    got = I._path_lengths(X, (feat, thr, left, right, size))
    assert len(calls) <= len(feat)
    for x, h in zip(X, got):
        node, depth = 0, 0
        while feat[node] >= 0:
            node, depth = (left if x[feat[node]] < thr[node] else right)[node], depth + 1
        assert h == depth + plain(size[node])
