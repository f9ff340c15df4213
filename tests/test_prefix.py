"""Prefix sums with edges per group against numpy."""

import numpy as np
import pandas as pd
import pytest

from quarry.functions import prefix


def brute(pdf, descending, inclusive):
    out = {}
    for g, part in pdf.dropna(subset=["g"]).groupby("g"):
        part = part.sort_values("v", ascending=not descending)
        cum = part["c"].cumsum()
        for v, n, c in zip(part["v"], part["c"], cum):
            out[(g, v)] = float(c if inclusive else c - n)
    return out


def table(sizes, scales):
    rng = np.random.default_rng(5)
    parts = [pd.DataFrame({"g": g, "v": np.unique(rng.standard_normal(n) * s), "c": rng.integers(1, 9, n)})
             for g, (n, s) in enumerate(zip(sizes, scales))]
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("descending,inclusive", [(False, False), (True, True)])
def test_groups_of_different_scale_and_size(spark, descending, inclusive):
    pdf = table([5000, 700, 1, 40], [1e-6, 1e9, 1.0, 3.0])
    df = spark.createDataFrame(pdf).repartition(5)
    out = prefix.prefix_sums(df, "v", ["c"], "g", descending, inclusive, n_buckets=64, rows_per_bucket=50).toPandas()
    assert len(out) == len(pdf)
    want = brute(pdf, descending, inclusive)
    assert all(want[(r.g, r.v)] == r.c_cum for r in out.itertuples())


def test_buckets_follow_the_rows_of_each_group(spark):
    pdf = table([6400, 640, 10], [1e-6, 1e9, 1.0])
    keyed = spark.createDataFrame(pdf).selectExpr("g as __g", "v as __k")
    edges = prefix.group_edges(keyed, n_buckets=64, rows_per_bucket=100)
    sizes = {r["__g"]: len(r["__e"]) + 1 for r in edges.collect()}
    assert sizes == {0: 64, 1: 7, 2: 1}
    counts = prefix._with_bucket(keyed, edges, 63).groupBy("__g", "__b").count().toPandas()
    assert counts["count"].max() <= 200  # the narrow group is cut as evenly as the wide one


def test_more_groups_than_are_broadcast(spark, monkeypatch):
    pdf = table([30] * 12, [10.0 ** k for k in range(-6, 6)])
    df = spark.createDataFrame(pdf)
    want = brute(pdf, False, True)
    monkeypatch.setattr(prefix, "MAX_EDGE_GROUPS", 3)
    out = prefix.prefix_sums(df, "v", ["c"], "g", inclusive=True, n_buckets=16, rows_per_bucket=4).toPandas()
    assert len(out) == len(pdf) and all(want[(r.g, r.v)] == r.c_cum for r in out.itertuples())


def test_missing_keys_groups_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", float("nan"), 3), ("a", 0.5, 4), (None, 1.0, 9), ("b", None, 5)],
                               "g string, v double, c int")
    rows = {(r["g"], str(r["v"])): r["c_cum"] for r in prefix.prefix_sums(df, "v", ["c"], "g", inclusive=True).collect()}
    assert rows == {("a", "0.5"): 4.0, ("a", "1.0"): 6.0, ("a", "nan"): 9.0, ("b", "None"): 5.0}
    assert prefix.prefix_sums(df.limit(0), "v", ["c"], "g").count() == 0
    one = prefix.prefix_sums(df.where("g = 'a'"), "v", ["c"]).collect()
    assert sorted(r["c_cum"] for r in one) == [0.0, 4.0, 6.0]
