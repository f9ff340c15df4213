import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.quantiles import column_quantiles, grouped_quantiles, landmarks


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 6000
    a = rng.normal(size=n)
    b = np.where(rng.random(n) < 0.4, 7.0, np.round(rng.exponential(2, n), 1))  # heavy ties
    c = rng.normal(size=n) * 1e-6 + 1e6
    g = rng.integers(0, 3, n)
    return [(float(x), None if i % 11 == 0 else float(y), float("nan") if i % 13 == 0 else float(z), int(k))
            for i, (x, y, z, k) in enumerate(zip(a, b, c, g))]


def columns(rows):
    t = np.array([[np.nan if v is None else v for v in r] for r in rows])
    return t[:, 0], t[:, 1], t[:, 2], t[:, 3]


PROBS = [0.0, 0.01, 0.25, 0.5, 0.777, 0.975, 1.0]


@pytest.mark.parametrize("accuracy", [10_000, 50])  # 50: brackets are used, and may miss
def test_exact_with_ties_nulls_and_brackets(spark, rows, accuracy):
    df = spark.createDataFrame(rows, "a double, b double, c double, g int").repartition(5)
    got = grouped_quantiles(df, [F.col("a"), F.col("b"), F.col("c")], PROBS, accuracy=accuracy)[()]
    for mine, x in zip(got, columns(rows)):
        assert np.allclose(mine, np.nanquantile(x, PROBS), rtol=1e-12, atol=0)


def test_groups_on_different_scales(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, c double, g int").withColumn("v", F.col("a") * F.pow(F.lit(1000.0), F.col("g")))
    df = df.withColumn("g", F.when(F.col("g") == 1, None).otherwise(F.col("g")))
    got = grouped_quantiles(df, [F.col("v")], PROBS, ["g"], accuracy=60)
    a, _, _, g = columns(rows)
    for k, key in ((0, (0,)), (1, (None,)), (2, (2,))):
        assert np.allclose(got[key][0], np.quantile(a[g == k] * 1000.0 ** k, PROBS), rtol=1e-9)


def test_landmarks_and_empty(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, c double, g int")
    probs = list(np.linspace(0, 1, 200))
    got = landmarks(df, [F.col("a"), F.col("b")], probs)
    assert np.allclose(got[0], np.quantile(columns(rows)[0], probs), rtol=1e-12)
    assert np.allclose(got[1], np.nanquantile(columns(rows)[1], probs), rtol=1e-12)
    assert column_quantiles(df.filter("false"), ["a"], [0.5]) == {"a": [None]}
    assert landmarks(df.filter("false"), [F.col("a")], probs) == [[None] * 200]
