"""Spark ML estimators behind one fit/transform interface (T, N families).

Features are assembled into a vector, class labels are coded in bin-aware
label order (B7/B8) and predictions are decoded back to the original text;
class probabilities come back as ``prob_<class>`` columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from quarry.functions.exprs import col, to_double
from quarry.functions.labels import order_labels


def assemble(df: DataFrame, feats: Sequence[str], out: str = "__x") -> DataFrame:
    tmp = df.select("*", *[to_double(f).alias(f"__a{i}") for i, f in enumerate(feats)])
    return VectorAssembler(inputCols=[f"__a{i}" for i in range(len(feats))], outputCol=out,
                           handleInvalid="keep").transform(tmp).drop(*[f"__a{i}" for i in range(len(feats))])


def class_list(df: DataFrame, label: str) -> list[str]:
    """The classes in bin order: one value per class, which a classifier holds anyway."""
    vals = [r[0] for r in df.select(col(label).cast("string")).where(F.col(label).isNotNull())
            .distinct().collect()]
    return order_labels(vals)


def encode_label(df: DataFrame, label: str, classes: Sequence[str], out: str = "__y") -> DataFrame:
    arr = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out, (F.array_position(arr, col(label).cast("string")) - 1).cast("double"))


@dataclass
class FittedSpark:
    model: object
    features: list
    classes: list | None = None
    pred_col: str = "prediction"

    def transform(self, df: DataFrame) -> DataFrame:
        data = assemble(df, self.features)
        out = self.model.transform(data)
        if self.classes is None:
            return out.withColumn(self.pred_col, F.col("__pred")).drop("__x", "__pred")
        arr = F.array(*[F.lit(c) for c in self.classes])
        out = out.withColumn(self.pred_col, F.element_at(arr, F.col("__pred").cast("int") + 1))
        if "__prob" in out.columns:
            p = vector_to_array("__prob")
            for i, c in enumerate(self.classes):
                out = out.withColumn(f"prob_{c}", p[i])
        drop = [c for c in ("__x", "__pred", "__prob", "__raw") if c in out.columns]
        return out.drop(*drop)


@dataclass
class SparkEstimator:
    """factory() -> unfitted Spark ML estimator; task 'regression'|'classification'."""
    factory: Callable
    task: str
    name: str = ""

    def fit(self, df: DataFrame, features: Sequence[str], target: str, weight_col: str | None = None) -> FittedSpark:
        est = self.factory()
        data = assemble(df, features)
        classes = None
        if self.task == "classification":
            classes = class_list(df, target)
            data = encode_label(data, target, classes)
        else:
            data = data.withColumn("__y", to_double(target))
        data = data.where(F.col("__y").isNotNull())
        est = est.setFeaturesCol("__x").setLabelCol("__y").setPredictionCol("__pred")
        from pyspark.ml.classification import OneVsRest
        ovr = isinstance(est, OneVsRest)
        if self.task == "classification" and hasattr(est, "setProbabilityCol") and not ovr:
            est = est.setProbabilityCol("__prob")
        if self.task == "classification" and hasattr(est, "setRawPredictionCol") and not ovr:
            est = est.setRawPredictionCol("__raw")
        if weight_col and hasattr(est, "setWeightCol"):
            est = est.setWeightCol(weight_col)
        return FittedSpark(est.fit(data), list(features), classes)


def _ml():
    from pyspark.ml import classification as C, regression as R
    return C, R


def _depth(max_depth: int) -> int:
    """Spark trees go to depth 30; more is refused rather than cut."""
    if max_depth > 30:
        raise ValueError(f"max_depth {max_depth}: Spark trees are at most 30 deep")
    return max_depth


def _tree_factory(cls, task: str, min_leaf: int, criterion: str | None, **kw) -> Callable:
    """``criterion``: gini or entropy for classes, squared_error for numbers."""
    offered = {"classification": {"gini": "gini", "entropy": "entropy"}, "regression": {"squared_error": "variance"}}[task]
    if criterion is not None and criterion not in offered:
        raise ValueError(f"criterion {criterion!r}: {', '.join(offered)} are offered for {task}")
    impurity = offered[criterion] if criterion else next(iter(offered.values()))
    return lambda: cls(minInstancesPerNode=min_leaf, impurity=impurity, maxBins=64, **kw)


def decision_tree(task: str, max_depth: int = 30, seed: int = 42, min_leaf: int = 1, criterion: str | None = None) -> SparkEstimator:
    C, R = _ml()
    cls = C.DecisionTreeClassifier if task == "classification" else R.DecisionTreeRegressor
    return SparkEstimator(_tree_factory(cls, task, min_leaf, criterion, maxDepth=_depth(max_depth), seed=seed), task, "DecisionTree")


def random_forest(task: str, n_trees: int = 100, subset: str = "sqrt", seed: int = 42, max_depth: int = 16,
                  min_leaf: int = 1, criterion: str | None = None) -> SparkEstimator:
    C, R = _ml()
    cls = C.RandomForestClassifier if task == "classification" else R.RandomForestRegressor
    return SparkEstimator(_tree_factory(cls, task, min_leaf, criterion, numTrees=n_trees, featureSubsetStrategy=subset, seed=seed,
                                        maxDepth=_depth(max_depth)), task, "RF")


def bagging(task: str, n_trees: int = 10, seed: int = 42, max_depth: int = 16, min_leaf: int = 1) -> SparkEstimator:
    """Bootstrap aggregation of full-feature trees."""
    return random_forest(task, n_trees, "all", seed, max_depth, min_leaf)


def logistic(C_: float = 1.0, max_iter: int = 100):
    """L2 logistic regression; C maps to regParam = 1 / (C * n)."""
    Cl, _ = _ml()

    class _Logistic(SparkEstimator):
        def fit(self, df, features, target, weight_col=None):
            n = df.count()
            self.factory = lambda: Cl.LogisticRegression(regParam=1.0 / (C_ * max(n, 1)), elasticNetParam=0.0,
                                                         standardization=False, maxIter=max_iter,
                                                         family="multinomial")
            return SparkEstimator.fit(self, df, features, target, weight_col)

    return _Logistic(None, "classification", "Logistic")


def linear_svc(C_: float = 1.0, max_iter: int = 1000):
    """C11: one-vs-rest linear SVM with plain hinge loss (``gradient`` has the squared one)."""
    Cl, _ = _ml()

    class _SVC(SparkEstimator):
        def fit(self, df, features, target, weight_col=None):
            n = df.count()
            self.factory = lambda: Cl.OneVsRest(classifier=Cl.LinearSVC(regParam=1.0 / (C_ * max(n, 1)),
                                                                        maxIter=max_iter))
            return SparkEstimator.fit(self, df, features, target, weight_col)

    return _SVC(None, "classification", "LinearSVC")


def huber(epsilon: float = 1.35, alpha: float = 1e-4):
    """Spark LinearRegression with Huber loss."""
    _, R = _ml()
    return SparkEstimator(lambda: R.LinearRegression(loss="huber", epsilon=epsilon, regParam=alpha,
                                                     elasticNetParam=0.0, standardization=False),
                          "regression", "Huber")


def mlp_native(layers: Sequence[int], seed: int = 42, max_iter: int = 200):
    """Spark's multilayer perceptron classifier (sigmoid hidden layers)."""
    Cl, _ = _ml()

    class _MLP(SparkEstimator):
        def fit(self, df, features, target, weight_col=None):
            k = len(class_list(df, target))
            self.factory = lambda: Cl.MultilayerPerceptronClassifier(
                layers=[len(features), *layers, k], seed=seed, maxIter=max_iter)
            return SparkEstimator.fit(self, df, features, target, weight_col)

    return _MLP(None, "classification", "MLP")
