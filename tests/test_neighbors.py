import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quarry.operators import neighbors


def _frame(spark, X, ids=None):
    ids = ids if ids is not None else range(len(X))
    return spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(ids, X)], "id long, x double, y double")


def test_knn_join_vs_brute_force(spark):
    rng = np.random.default_rng(4)
    R, Q = rng.normal(size=(120, 2)), rng.normal(size=(30, 2))
    refs, qs = _frame(spark, R), _frame(spark, Q, range(1000, 1030))
    out = neighbors.knn_join(qs, refs, "id", "id", ["x", "y"], 4, block_rows=25)  # several tiles
    got = {}
    for r in out.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["nbr_id"]))
    for qi, q in enumerate(Q):
        d = np.sqrt(((R - q) ** 2).sum(1))
        want = list(np.lexsort((np.arange(len(R)), d))[:4])
        assert [rid for _, rid in sorted(got[1000 + qi])] == want


def test_radius_join_vs_brute_force(spark):
    rng = np.random.default_rng(5)
    X = rng.uniform(0, 3, size=(80, 2))
    df = _frame(spark, X)
    pairs = {(r["q"], r["r"]) for r in neighbors.radius_join(df, df, "id", "id", ["x", "y"], 0.5, block_rows=30).collect()}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    want = {(i, j) for i in range(80) for j in range(80) if D[i, j] <= 0.5}
    assert pairs == want


def _dbscan_ref(X, eps, ms):
    n = len(X)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    nb = [np.where(D[i] <= eps)[0] for i in range(n)]
    core = {i for i in range(n) if len(nb[i]) >= ms}
    lab = {}
    for c in sorted(core):
        if c in lab:
            continue
        comp, stack = {c}, [c]
        while stack:
            u = stack.pop()
            for v in nb[u]:
                if v in core and v not in comp:
                    comp.add(v)
                    stack.append(v)
        for v in comp:
            lab[v] = min(comp)
    out = {}
    for i in range(n):
        if i in lab:
            out[i] = lab[i]
        else:
            cs = [lab[j] for j in nb[i] if j in core]
            out[i] = min(cs) if cs else -1
    return out


def test_dbscan_vs_reference(spark):
    rng = np.random.default_rng(6)
    X = np.vstack([rng.normal(0, 0.2, (40, 2)), rng.normal(3, 0.2, (40, 2)), rng.uniform(-2, 5, (10, 2))])
    got = {r["id"]: r["cluster"] for r in neighbors.dbscan(_frame(spark, X), "id", ["x", "y"], 0.3, 5).collect()}
    assert got == _dbscan_ref(X, 0.3, 5)


def test_nearest_center_ties_to_lowest(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0)], "x double, y double")
    out = [r["c"] for r in neighbors.nearest_center(df, ["x", "y"], [[1.0, 0.0], [1.0, 0.0], [2.0, 0.0]], "c").collect()]
    assert out == [0, 2]


def test_lof_vs_numpy(spark):
    rng = np.random.default_rng(7)
    X = np.vstack([rng.normal(0, 1, (60, 2)), [[8.0, 8.0]]])
    k = 5
    out = {r["id"]: r["lof"] for r in neighbors.local_outlier_factor(_frame(spark, X), "id", ["x", "y"], k, 0.1).collect()}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    N = np.argsort(D, axis=1, kind="stable")[:, :k]
    kd = D[np.arange(len(X)), N[:, -1]]
    reach = np.maximum(D[np.arange(len(X))[:, None], N], kd[N])
    lrd = 1 / (reach.mean(1) + 1e-10)
    lof = lrd[N].mean(1) / lrd
    assert np.allclose([out[i] for i in range(len(X))], lof)
    assert out[60] == max(out.values())


def test_pivots_prune_and_keep_every_neighbour(spark):
    rng = np.random.default_rng(8)
    blobs = rng.uniform(-50, 50, (12, 2))
    R = np.concatenate([rng.normal(b, 0.5, (60, 2)) for b in blobs])
    R[100:160] = R[100]                                # many copies of one point
    R = np.concatenate([R, rng.integers(-3, 4, (80, 2))])  # ties
    df = _frame(spark, R, rng.permutation(len(R)))
    ids = np.array([r["id"] for r in df.collect()])
    for k, own in ((4, False), (7, True), (70, True)):
        out = neighbors.knn_join(df, df, "id", "id", ["x", "y"], k, exclude_self=own, block_rows=50)
        got = {}
        for r in out.collect():
            got.setdefault(r["id"], {})[r["rank"]] = r["nbr_id"]
        for a in range(0, len(R), 7):
            d = np.sqrt(((R - R[a]) ** 2).sum(1))
            d[a] = np.inf if own else d[a]
            want = ids[np.lexsort((ids, d))[:k]]
            assert [got[ids[a]][j + 1] for j in range(k)] == list(want)
    points = neighbors._points(df, "id", ["x", "y"])
    _, sent = neighbors.knn_candidates(points, points, 4, True, 50, 16)
    assert sent.count() < 2 * len(R)  # of 15 other cells each


def test_rows_without_a_place_meet_nothing(spark):
    rows = [(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 0.0), (4, float("inf"), 1.0), (5, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    assert {(r["q"], r["r"]) for r in neighbors.radius_join(df, df, "id", "id", ["x", "y"], 0.0).collect()} == {(1, 1), (1, 5), (5, 1), (5, 5)}
    assert {(r["id"], r["nbr_id"]) for r in neighbors.knn_join(df, df, "id", "id", ["x", "y"], 3).collect()} == {(1, 1), (1, 5), (5, 1), (5, 5)}
    none = df.where("false")
    assert neighbors.knn_join(df, none, "id", "id", ["x", "y"], 3).count() == 0
    got = neighbors.dbscan(df, "id", ["x", "y"], 0.1, 2).collect()
    assert sorted((r["id"], r["cluster"]) for r in got) == [(1, 1), (2, -1), (3, -1), (4, -1), (5, 1)]


def test_grid_copies_do_not_grow_with_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    seen = []
    meet = neighbors._meet
    monkeypatch.setattr(neighbors, "_meet", lambda q, r, *a: seen.append((q.count(), r.count())) or meet(q, r, *a))
    for n in (300, 900):
        df = _frame(spark, rng.uniform(0, 40, (n, 2)))
        neighbors.radius_join(df, df, "id", "id", ["x", "y"], 0.5, block_rows=40)
    assert seen == [(300, 2700), (900, 8100)]


def test_radius_edges_of_cells(spark):
    x = [0.1 * k for k in range(200)] + [-0.1 * k for k in range(1, 100)]
    X = np.array([(a, 0.0) for a in x])
    df = _frame(spark, X)
    got = {(r["q"], r["r"]) for r in neighbors.radius_join(df, df, "id", "id", ["x", "y"], 0.1, block_rows=64).collect()}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    assert got == {(i, j) for i, j in zip(*np.nonzero(D <= 0.1))}


def test_dbscan_of_a_dense_spot_and_a_chain(spark):
    rng = np.random.default_rng(10)
    X = np.vstack([rng.normal(0, 0.01, (150, 2)), [(0.25 * k, 2.0) for k in range(60)], np.repeat([[9.0, 9.0]], 30, axis=0), rng.uniform(-5, 5, (30, 2))])
    got = {r["id"]: r["cluster"] for r in neighbors.dbscan(_frame(spark, X), "id", ["x", "y"], 0.3, 3, block_rows=32).collect()}
    assert got == _dbscan_ref(X, 0.3, 3)
    tile = np.array([[True, False, False], [True, True, False], [False, False, True]])
    u, v = neighbors._forest(tile, np.array([5, 9, 4]), np.array([5, 7, 8]))
    assert set(zip(u, v)) == {(7, 5), (9, 5), (8, 4)}


def test_radius_regression_of_crowded_cells(spark):
    rng = np.random.default_rng(11)
    X = rng.uniform(0, 1, (200, 2))
    y = rng.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(b), float(t) if i % 9 else None) for i, ((a, b), t) in enumerate(zip(X, y))],
                               "id long, x double, y double, t double")
    far = spark.createDataFrame([(900, 50.0, 50.0, 0.0)], df.schema)
    got = {r["id"]: r["prediction"] for r in neighbors.radius_regress(df, df.union(far), "id", ["x", "y"], "t", 0.3).collect()}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1)) <= 0.3
    has = np.arange(200) % 9 != 0
    for i in range(200):
        assert abs(got[i] - y[D[i] & has].mean()) < 1e-9
    assert got[900] is None


def test_small_cells_share_tasks_and_crowded_ones_are_cut(spark):
    rng = np.random.default_rng(15)
    X = np.concatenate((rng.uniform(0, 40, size=(300, 2)), rng.uniform(0, 0.4, size=(90, 2))))
    pts = neighbors._points(_frame(spark, X), "id", ["x", "y"])

    def links(qdf, rdf, near):
        return pd.DataFrame({"n": [int(near.sum())]})
    got = neighbors.radius_tiles(pts, pts, 2, 0.5, links, "n long", block_rows=64).collect()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    assert sum(r["n"] for r in got) == (D <= 0.5).sum()
    assert len(got) < 150  # not one call for each of some 300 cells


def test_nearest_center_meets_all_centers_in_batches(spark):
    """No step per feature and center is interpreted for every row."""
    rng = np.random.default_rng(8)
    X, C = rng.normal(size=(300, 6)), rng.normal(size=(40, 6))
    rows = [(i, *map(float, x)) for i, x in enumerate(X)]
    rows += [(300, None, *[1.0] * 5), (301, float("nan"), *[1.0] * 5), (302, float("inf"), *[1.0] * 5)]
    feats = [f"x{j}" for j in range(6)]
    out = neighbors.nearest_center(spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} double" for f in feats)), feats, C.tolist(), "c")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "ArrowEvalPython" in plan
    got = {r["id"]: r["c"] for r in out.collect()}
    want = ((X[:, None] - C[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [got[i] for i in range(300)] == want.tolist()
    assert (got[300], got[301], got[302]) == (None, 0, 0)


def test_nearest_rows_of_a_tile_are_exact_and_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(21)
    monkeypatch.setattr(neighbors, "SLICE", 500)
    held = []
    partition = np.partition
    monkeypatch.setattr(neighbors.np, "partition", lambda D, *a, **k: held.append(D.size) or partition(D, *a, **k))
    for X in (rng.normal(size=(120, 8)), 1e8 + rng.normal(size=(120, 8)), rng.integers(0, 2, (120, 3)).astype(float),
              1e160 * rng.normal(size=(120, 2)), 1e-170 * rng.normal(size=(120, 2))):
        ids = rng.permutation(90)[np.arange(120) % 90]  # some repeat
        with np.errstate(over="ignore"):
            D = neighbors._dist_tile(X, X)
        for own, k in ((True, 5), (False, 3), (True, 119)):
            Z = np.where((ids[:, None] == ids[None, :]) & own, np.inf, D)
            kth = np.sort(Z, axis=1)[:, k - 1]
            for bound in (np.full(120, np.inf), kth):
                got = {}
                for row, at, dist in neighbors._nearest(X, X, ids, ids, k, own, bound):
                    for i, j, d in zip(row, at, dist):
                        got.setdefault(i, []).append((d, ids[j]))
                for i in range(120):
                    want = sorted((d, ids[j]) for j, d in enumerate(Z[i]) if np.isfinite(d))[:k]
                    assert [x[1] for x in got.get(i, [])] == [x[1] for x in want]
                    assert np.allclose([x[0] for x in got.get(i, [])], [x[0] for x in want], rtol=1e-12, atol=0)
    assert max(held) <= 500


def test_copies_of_queries_come_in_pieces_with_their_bound(spark, monkeypatch):
    rng = np.random.default_rng(22)
    X = rng.normal(size=(600, 12))  # nearly every query visits every cell
    feats = [f"x{j}" for j in range(12)]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "id long, " + ", ".join(f"{f} double" for f in feats))
    points = neighbors._points(df, "id", feats)
    cand, sent = neighbors.knn_candidates(points, points, 4, True, 100, 6)
    assert sent.count() > 600 and sent.where("bound IS NULL OR isnan(bound)").isEmpty()
    assert cand.count() < 3 * 4 * 600 < 4 * (600 + sent.count())  # not the 4 nearest of every cell
    D = neighbors._dist_tile(X, X)
    np.fill_diagonal(D, np.inf)
    got = {(r["id"], r["rank"]): r["nbr_id"] for r in neighbors.knn_join(df, df, "id", "id", feats, 4, True, block_rows=100).collect()}
    assert got == {(i, n + 1): int(j) for i in range(600) for n, j in enumerate(np.argsort(D[i], kind="stable")[:4])}
