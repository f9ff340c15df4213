import hashlib

import numpy as np

from quarry.operators import explain, linear
from quarry.sources import sinks


def test_a_repeat_ranks_once_for_all_features(spark, monkeypatch):
    rng = np.random.default_rng(5)
    X = rng.integers(0, 20, (120, 3)).astype(float)
    y = X @ [3.0, -1.0, 0.0] + rng.normal(size=120)
    df = spark.createDataFrame([(i, *map(float, x), float(v)) for i, (x, v) in enumerate(zip(X, y))], "id long, a double, b double, c double, y double")
    m = linear.fit_ols(df, ["a", "b", "c"], "y") if hasattr(linear, "fit_ols") else None
    if m is None:
        from quarry.plans import models
        m = models.make("Linear").fit(df, ["a", "b", "c"], "y")
    calls, plain = [], sinks._distributed_rank
    monkeypatch.setattr(sinks, "_distributed_rank", lambda d, k: calls.append(k) or plain(d, k))
    got = {r["feature"]: r for r in explain.permutation_importance(m, df, ["a", "b", "c"], "y", ["id"], repeats=2, seed=7).collect()}
    assert len(calls) == 3  # the rows' own ranks and one of each repeat

    def order(salt):
        return sorted(range(120), key=lambda i: hashlib.md5(f"{salt}|{i}".encode()).hexdigest())

    def r2(Z):
        return 1 - ((y - m.intercept - Z @ np.array(m.coef)) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    for j, f in enumerate("abc"):
        drops = []
        for rep in range(2):
            Z = X.copy()
            Z[order("perm-base"), j] = X[order(f"7|{rep}"), j]
            drops.append(r2(X) - r2(Z))
        assert abs(got[f]["importance_mean"] - np.mean(drops)) < 1e-9 and abs(got[f]["importance_sd"] - np.std(drops)) < 1e-9
