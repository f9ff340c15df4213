from pyspark.sql import functions as F

from quarry.sources.ingest import letters_to_columns
from quarry.sources.sinks import downsample_evenly

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def test_letters_to_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], "a int, b int, c int, d int, e int, f int")
    assert letters_to_columns(df, "A-D,F") == ["a", "b", "c", "d", "f"]
    assert letters_to_columns(df, "B, b, E") == ["b", "e"]


def test_downsample_evenly_positions(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    out = downsample_evenly(df, ["k"], 50)
    assert out.count() == 50  # positions floor(i * 999 / 49) are distinct
    assert downsample_evenly(spark.range(10).select(F.col("id").alias("k")), ["k"], 50).count() == 10


def test_grid_search_picks_best(spark, sf):
    from quarry.plans import models, tune
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    res, best = tune.search(li, ["l_quantity", "l_discount"], "l_extendedprice", "Ridge",
                            {"alpha": [0.1, 1000.0]},
                            lambda p: models.GramTrainer("ridge", {"alpha": p["alpha"]}), KEYS, k=3)
    scores = {r["params"]: r["score"] for r in res.collect()}
    assert str(best) in scores and scores[str(best)] == max(scores.values())


def test_distinct_counts_match_plain_sets(spark):
    import datetime as dt
    from quarry.operators.profile import distinct_counts
    rows = [(1, "a", 0.0, dt.datetime(2020, 10, 25, 1)), (1, None, -0.0, None), (2, "", float("nan"), None),
            (None, "a", float("nan"), dt.datetime(2020, 10, 25, 2))]
    df = spark.createDataFrame(rows, "`i.x` int, s string, d double, w timestamp")
    assert distinct_counts(df, df.columns) == {"i.x": 2, "s": 2, "d": 2, "w": 2}
    assert distinct_counts(df.limit(0), ["s"]) == {"s": 0} and distinct_counts(df, []) == {}
