import hashlib
import math
import random

import numpy as np
import pytest

from quarry.llm import bitplane_clusters as C


def brute(rows, k, rounds, scale=64.0, seed=1):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(nearest(v)[1], []).append(v)
        cents = [[sum(col) // len(held[j]) for col in zip(*held[j])] if j in held else c for j, c in enumerate(cents)]
    found = [(i, *nearest(v)) for i, v in kept]
    per = {}
    for _, d, j in found:
        per[j] = per.get(j, 0) + d
    return sorted((str(i), j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in found)


def rows_of(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_planes_give_exact_products():
    rng = np.random.default_rng(0)
    for top in (1, 2, 64, 1000, C.LIMIT - 1):
        a, b = rng.integers(-top, top + 1, (50, 64)), rng.integers(-top, top + 1, (3, 64))
        pa_, pb = C.pack(a), C.pack(b)
        assert (C.dots(pa_, pa_) == (a * a).sum(1)).all()
        for k in range(3):
            assert (C.dots(pa_, pb[k]) == a @ b[k]).all()
        which = rng.integers(0, 4, 50)
        assert (C.cluster_sums(pa_, which, 4) == [a[which == c].sum(0) for c in range(4)]).all()
    assert C.pack(np.zeros((2, 64), np.int64)).shape == (2, 1)
    assert C.pack(np.full((1, 64), -1)).shape == (1, 1)


@pytest.mark.parametrize("k,rounds", [(16, 3), (3, 0), (5, 6)])
def test_clusters_match_brute_force(spark, k, rounds):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(rng.choice([-1, 0, 1]) if d < 4 else 0, 0.2) for d in range(64)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]                         # many copies
    rows += [rows[5], rows[5], (None, rows[7][1]), (None, rows[9][1])]       # repeated rows, null ids
    rows += [(300, None), (301, []), (302, [0.1] * 63), (303, [0.1] * 65), (304, [0.1] * 63 + [None]),
             (305, [0.1] * 63 + [float("nan")]), (306, [0.1] * 63 + [float("-inf")]), (307, [900.0] * 64), (308, [-0.0] * 64)]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(7)
    assert rows_of(C.clusters(df, k=k, rounds=rounds)) == brute(rows, k, rounds)


def test_few_none_and_too_large(spark):
    few = [(1, [0.5] * 64), (2, [0.25] * 64), (2, [0.25] * 64)]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    assert rows_of(C.clusters(df)) == brute(few, 16, 3)
    empty = C.clusters(df.filter("false"))
    assert empty.count() == 0 and empty.columns[0] == "vec_id"
    big = spark.createDataFrame([(k, [1e9] * 64) for k in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        C.clusters(big)


def test_empty_cluster_keeps_its_centroid(spark):
    # equal start vectors: the larger number never wins a tie, so its cluster stays empty
    rows = [(i, [0.5] * 64) for i in range(6)] + [(i, [-0.5 + 0.1 * (i % 2)] * 64) for i in range(6, 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(C.clusters(df, k=9)) == brute(rows, 9, 3)
