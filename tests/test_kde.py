import numpy as np

from quarry.operators import profile


def test_density_sums_every_row(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(size=6000), [20000.0]))  # bins of 4.9 against a bandwidth of 0.3
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    got = profile.kde_curve(df, "x", 50, bandwidth=0.3).orderBy("point").collect()
    grid = np.linspace(x.min(), x.max(), 50)
    want = np.exp(-0.5 * ((grid[:, None] - x) / 0.3) ** 2).sum(axis=1) / (len(x) * 0.3 * np.sqrt(2 * np.pi))
    assert np.allclose([r.x for r in got], grid)
    assert np.allclose([r.density for r in got], want, rtol=1e-9, atol=1e-300)
    binned = profile.kde_curve(df, "x", 50, bandwidth=0.3, fine_bins=4096).orderBy("point").collect()
    assert not np.allclose([r.density for r in binned], want, rtol=0.1)
    assert profile.kde_curve(df.filter("false"), "x").count() == 0
    same = profile.kde_curve(df.filter("x = 20000"), "x", 3).collect()
    assert np.allclose([r.density for r in same], 1 / np.sqrt(2 * np.pi))
