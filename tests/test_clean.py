from pyspark.sql import functions as F

from quarry.operators import clean
from quarry.sources.ingest import dedupe_names, read_csv


def test_drop_zero_all_keeps_null_rows(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, None), (1.0, 0.0)], "a double, b double")
    out = clean.drop_zero_rows(df, "all")
    assert out.count() == 2  # a NULL is not zero


def test_drop_zero_scope(spark):
    df = spark.createDataFrame([(0.0, 0.0, 5.0), (0.0, None, 1.0), (1.0, 0.0, 0.0)], "a double, b double, y double")
    out = clean.drop_zero_rows(df, "indicator", ["a", "b"], ["y"])
    assert out.count() == 2


def test_impute_mean_median_const(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (10.0,)], "x double")
    m = {r[0] for r in clean.impute(df, "mean", "all").collect()}
    assert 14.0 / 3 in m
    md = {r[0] for r in clean.impute(df, "median", "all").collect()}
    assert 3.0 in md and None not in md
    c = [r[0] for r in clean.impute(df, "0.01", "all").collect()]
    assert 0.01 in c


def test_replace_and_patterns(spark):
    df = spark.createDataFrame([("<5", 0.04), ("7", 0.06), ("x", 0.1)], "s string, v double")
    out = clean.replace_patterns(clean.replace_values(df, [0.04]), ["^<"]).collect()
    assert out[0]["s"] == "0" and out[0]["v"] == 0.0 and out[1]["v"] == 0.06


def test_coerce_and_non_numeric(spark):
    df = spark.createDataFrame([(">500",), ("1e3",), ("2",), (None,)], "t string")
    vals = [r[0] for r in clean.coerce_numeric(df, ["t"]).collect()]
    assert vals == [None, 1000.0, 2.0, None]
    bad = clean.non_numeric_sample(df, "t").first()
    assert bad["n_bad"] == 1 and bad["example"] == ">500"


def test_nan_and_inf_fallback(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (3.0,)], "x double")
    out, rep = clean.nan_fallback(df, ["x"])
    vals = sorted(r[0] for r in out.collect())
    assert vals == [0.0, 1.0, 2.0, 3.0]


def test_duplicate_headers(spark, tmp_path):
    assert dedupe_names(["a", "a", "b", "a"]) == ["a", "a.1", "b", "a.2"]
    p = tmp_path / "d.csv"
    p.write_text("a,a,b\n1,2,x\n3,4,y\n")
    df = read_csv(spark, str(p))
    assert df.columns == ["a", "a.1", "b"]
    assert df.count() == 2


def test_empty_csv_raises(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text("")
    import pytest
    with pytest.raises(ValueError):
        read_csv(spark, str(p))
