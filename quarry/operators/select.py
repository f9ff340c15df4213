"""Feature selection (K1-K4).

K1/K2 are score tables from one aggregation pass (F statistics need only
moments). K3/K4 rank features by Spark ML random-forest importances; RFE
re-fits on the surviving columns each round.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from quarry.functions.exprs import col, to_double


def _top_k(scores: DataFrame, k: int | None) -> DataFrame:
    w = Window.orderBy(F.desc_nulls_last("score"), F.asc("feature"))
    ranked = scores.withColumn("rank", F.row_number().over(w))  # one row per feature
    sel = F.lit(True) if not k else (F.col("rank") <= k)
    return ranked.withColumn("selected", sel)


def f_regression(df: DataFrame, features: Sequence[str], target: str, k: int | None = None) -> DataFrame:
    """K1: F = r^2 / (1 - r^2) * (n - 2) per feature (r: Pearson with target)."""
    y = to_double(target)
    aggs = []
    for i, f in enumerate(features):
        x = to_double(f)  # everything over the rows that have both values
        both = F.when(x.isNotNull(), y)
        aggs += [F.count(x).alias(f"n{i}"),
                 F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(both)).alias(f"r{i}")]
    wide = df.where(y.isNotNull()).agg(*aggs)
    parts = []
    for i, f in enumerate(features):
        r = F.col(f"r{i}")
        score = F.try_divide(r * r, F.lit(1.0) - r * r) * (F.col(f"n{i}") - 2)
        parts.append(F.struct(F.lit(f).alias("feature"), score.alias("score")))
    scores = wide.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
    return _top_k(scores, k)


def f_classif(df: DataFrame, features: Sequence[str], target: str, k: int | None = None) -> DataFrame:
    """K2: one-way ANOVA F per feature from per-class counts, means and variances."""
    g = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("__y")).agg(
        F.count(F.lit(1)).alias("n"),
        *[x for i, f in enumerate(features) for x in
          (F.avg(to_double(f)).alias(f"m{i}"), F.var_pop(to_double(f)).alias(f"v{i}"))])
    # classes x features statistics: tiny table
    tot = g.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("K"),
                *[F.try_divide(F.sum(F.col(f"m{i}") * F.col("n")), F.sum("n")).alias(f"gm{i}")
                  for i in range(len(features))]).first()
    agg = g.agg(F.lit(tot["N"]).alias("N"), F.lit(tot["K"]).alias("K"),
                *[x for i in range(len(features)) for x in
                  (F.sum(F.col("n") * (F.col(f"m{i}") - F.lit(tot[f"gm{i}"])) ** 2).alias(f"b{i}"),
                   F.sum(F.col("n") * F.col(f"v{i}")).alias(f"w{i}"))])
    parts = []
    for i, f in enumerate(features):
        score = F.try_divide(F.col(f"b{i}") / (F.col("K") - 1), F.col(f"w{i}") / (F.col("N") - F.col("K")))
        parts.append(F.struct(F.lit(f).alias("feature"), score.alias("score")))
    scores = agg.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
    return _top_k(scores, k)


ROWS_PER_TASK = 500_000  # a forest keeps a row's features and its counts in all trees


@contextmanager
def _kept(df: DataFrame, features: Sequence[str], target: str):
    """The columns that forests read, kept on disk while they are grown, in parts of
    about ``ROWS_PER_TASK`` rows if one has more."""
    slim = df.select(*[col(c) for c in dict.fromkeys([*features, target])]).persist(StorageLevel.DISK_ONLY)
    size = slim.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    try:
        if (size["most"] or 0) <= ROWS_PER_TASK:
            yield slim
        else:
            parts = slim.repartition(-(-size["n"] // ROWS_PER_TASK)).persist(StorageLevel.DISK_ONLY)
            try:
                yield parts
            finally:
                parts.unpersist()
    finally:
        slim.unpersist()


def _forest_importances(df: DataFrame, features: Sequence[str], target: str, task: str,
                        n_trees: int = 50, seed: int = 42) -> dict:
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    vec = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip").transform(df)
    if task == "classification":
        from pyspark.ml.classification import RandomForestClassifier
        vec = StringIndexer(inputCol=target, outputCol="__y", stringOrderType="alphabetAsc").fit(vec).transform(vec)
        m = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=n_trees, seed=seed).fit(vec)
    else:
        from pyspark.ml.regression import RandomForestRegressor
        vec = vec.withColumn("__y", to_double(target))
        m = RandomForestRegressor(featuresCol="__x", labelCol="__y", numTrees=n_trees, seed=seed).fit(vec)
    imp = m.featureImportances.toArray()
    return {f: float(imp[i]) for i, f in enumerate(features)}


def rfe(df: DataFrame, features: Sequence[str], target: str, k: int, task: str = "regression",
        n_trees: int = 50, seed: int = 42) -> DataFrame:
    """K3: drop the least important feature each round until k remain."""
    spark = df.sparkSession
    keep = list(features)
    ranking = {}
    if k <= 0:
        raise ValueError("k must be positive")
    step = len(keep)
    with _kept(df, features, target) as rows:
        while len(keep) > k:
            imp = _forest_importances(rows, keep, target, task, n_trees, seed)
            worst = min(keep, key=lambda f: (imp[f], f))
            ranking[worst] = step
            step -= 1
            keep.remove(worst)
    for f in keep:
        ranking[f] = 1
    return spark.createDataFrame([(f, int(ranking[f]), f in keep) for f in features],
                                 "feature string, rank int, selected boolean")


def select_from_model(df: DataFrame, features: Sequence[str], target: str, task: str = "regression",
                      n_trees: int = 50, seed: int = 42) -> DataFrame:
    """K4: keep features whose importance >= mean importance (k ignored)."""
    with _kept(df, features, target) as rows:
        imp = _forest_importances(rows, features, target, task, n_trees, seed)
    thr = sum(imp.values()) / max(len(imp), 1)
    return df.sparkSession.createDataFrame([(f, imp[f], imp[f] >= thr) for f in features],
                                           "feature string, importance double, selected boolean")
