import pytest
import math

from pyspark.sql import functions as F

from quarry.operators import split

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _li(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet")


def test_split_exact_size_and_deterministic(spark, sf):
    li = _li(spark, sf)
    n = li.count()
    a = split.train_test_split(li.select(*KEYS), KEYS, 0.2, 7)
    assert a.where("split = 'test'").count() == math.ceil(0.2 * n)
    b = split.train_test_split(li.select(*KEYS).repartition(13), KEYS, 0.2, 7)
    ta = {tuple(r) for r in a.where("split='test'").select(*KEYS).collect()}
    tb = {tuple(r) for r in b.where("split='test'").select(*KEYS).collect()}
    assert ta == tb  # partitioning does not change the split


def test_stratified_allocation(spark, sf):
    li = _li(spark, sf).select(*KEYS, "l_returnflag")
    out = split.train_test_split(li, KEYS, 0.2, 42, stratify="l_returnflag")
    counts = {r[0]: r[1] for r in li.groupBy("l_returnflag").count().collect()}
    n = sum(counts.values())
    nt = math.ceil(0.2 * n)
    alloc = split.largest_remainder(counts, nt)
    got = {r[0]: r[1] for r in out.where("split='test'").groupBy("l_returnflag").count().collect()}
    assert got == {k: v for k, v in alloc.items() if v}
    assert sum(got.values()) == nt


def test_kfold_sizes_and_invariance(spark, sf):
    li = _li(spark, sf).select(*KEYS)
    n = li.count()
    f = split.kfold(li, KEYS, 5, 3)
    sizes = sorted(r[1] for r in f.groupBy("fold").count().collect())
    assert sorted(split.kfold_sizes(n, 5)) == sizes
    g = split.kfold(li.repartition(7), KEYS, 5, 3)
    assert {tuple(r) for r in f.collect()} == {tuple(r) for r in g.collect()}


def test_stratified_kfold_round_robin_counts(spark, sf):
    li = _li(spark, sf).select(*KEYS, "l_returnflag")
    f = split.kfold(li, KEYS, 4, 1, stratify="l_returnflag")
    counts = {r[0]: r[1] for r in li.groupBy("l_returnflag").count().collect()}
    off = 0
    for c in sorted(counts):
        want = split.round_robin_sizes(off, counts[c], 4)
        off += counts[c]
        got = [f.where((F.col("l_returnflag") == c) & (F.col("fold") == i)).count() for i in range(4)]
        assert got == want


def test_quantile_strata_accepts(spark, sf):
    li = _li(spark, sf)
    df, q, counts = split.quantile_strata(li, "l_extendedprice", 5, 2, 0.2)
    assert q == 5 and sum(counts.values()) == li.count()


def test_too_small_strata_rejected(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "y double")
    got, q, counts = split.quantile_strata(df, "y", 5, 2, 0.2)
    assert got is None


def test_rank_fallback_and_robustness_strata(spark):
    # heavy ties: 80 % of rows on one value -> value quantiles collapse
    rows = [(float(i), 0.0 if i < 80 else float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id double, y double")
    got, q, counts = split.quantile_strata(df, "y", 5, 2, 0.2)
    assert got is not None and sum(counts.values()) == 100
    g2, how, c2 = split.robustness_strata(df, "y")
    assert sum(c2.values()) == 100 and len(c2) >= 2 and min(c2.values()) >= 2
    with pytest.raises(ValueError):
        split.robustness_strata(df.limit(3).withColumn("y", df["id"]), "y")


def _ranked_pieces(rows, cuts, seed="s"):
    """Plain loop: pieces by the rank of md5(seed|key) within the stratum; equal hashes stay together."""
    import hashlib
    by = {}
    for k, s in rows:
        by.setdefault(s, []).append(hashlib.md5(f"{seed}|{k}".encode()).hexdigest())
    out = []
    for k, s in rows:
        hs = sorted(by[s])
        h = hashlib.md5(f"{seed}|{k}".encode()).hexdigest()
        out.append((k, s, sum(h >= hs[c] for c in cuts(s, len(hs)) if c < len(hs))))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_window", [1, 7, 10_000])
def test_cuts_are_exact_however_small_the_windows(spark, max_window):
    # a large stratum, a small one, missing strata, and a key that half of one stratum holds
    rows = ([(i, "a") for i in range(9000)] + [(i, "b") for i in range(5)] + [(i, None) for i in range(300)]
            + [(7, "c")] * 400 + [(i, "c") for i in range(1000, 1400)])
    cuts = lambda s, n: [n // 5, n // 2, n - 1, n, n + 3]
    df = spark.createDataFrame(rows, "k long, s string").repartition(6)
    got = split.assign_pieces(df, "s", ["k"], cuts, "s", max_window=max_window)
    assert got.columns == ["k", "s", "piece"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _ranked_pieces(rows, cuts)


def test_more_strata_than_cases(spark):
    rows = [(i, f"g{i % 150}") for i in range(1500)] + [(5000 + i, None) for i in range(9)]
    df = spark.createDataFrame(rows, "k long, s string")
    cuts = lambda s, n: [n // 3, 2 * n // 3]
    got = split.assign_pieces(df, "s", ["k"], cuts, "s")
    assert sorted((tuple(r) for r in got.collect()), key=str) == _ranked_pieces(rows, cuts)


def test_split_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k long, s string")
    assert split.train_test_split(df, ["k"], 0.2, 1, stratify="s").count() == 0
    assert split.kfold(df, ["k"], 3, 1).count() == 0


def test_splits_by_prefixes_are_the_same(spark):
    rows = [(i // 3, None if i % 7 == 0 else i % 5, i % 90) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, s long, many long").repartition(3)
    with_prefix, names = split.hash_prefixes(df, ["k"], [1, 2, 1])
    assert list(names) == [1, 2]
    for seed, name in names.items():
        for how in (None, "s", "many"):
            for fn, args in ((split.train_test_split, (0.2, seed, how)), (split.kfold, (4, seed, how))):
                want = sorted(map(str, fn(df, ["k"], *args).collect()))
                assert sorted(map(str, fn(with_prefix, ["k"], *args, prefix=name).drop(*names.values()).collect())) == want
