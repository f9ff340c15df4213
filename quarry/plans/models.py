"""Model registry: reference model keys -> trainers (plug-in point).

``make(key, params)`` builds a trainer; the hyper-parameters are the keyword
arguments of the key's builder, under the names users of the reference know, and an
unknown one raises. A trainer has ``fit(df, features, target) -> fitted`` and the
fitted object has ``transform(df)`` adding a ``prediction`` column (classifiers may
add ``prob_<class>``). Cluster entries take ``(df, features, k)``.

NuSVR, NuSVC, affinity propagation, OPTICS and HDBSCAN are dense or sequential
single-machine solvers: their keys are known but raise ``NotImplementedError``
(``UNSUPPORTED``), so that no model runs under another's name.
"""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field
from itertools import combinations_with_replacement
from typing import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quarry.functions.exprs import col, to_double
from quarry.operators import bayes, cluster, gradient, iterative, linear, native, neighbors, split, trees
from quarry.operators.bayes import ScoreModel
from quarry.session import cut_lineage


@dataclass
class GramTrainer:
    """G family from one moments pass. X and y are standardised unless the caller has
    scaled them already (``scale_x``, ``scale_y``). ``cv``: the penalty is chosen by
    k-fold error first; folds are dealt by ``keys`` (default: all columns)."""
    method: str
    params: dict = field(default_factory=dict)
    cv: bool = False
    scale_x: bool = True
    scale_y: bool = True
    keys: Sequence[str] | None = None

    def fit(self, df: DataFrame, features: Sequence[str], target: str):
        feats = list(features)
        if not self.cv:
            return self.fit_moments(linear.moments(df, feats + [target])[None], feats, target)
        kw = dict(self.params)
        k, alphas, n_alphas = kw.pop("folds", 5), kw.pop("alphas", None), kw.pop("n_alphas", 100)
        folded = split.kfold(df, list(self.keys or df.columns), k, out_col="__fold")
        fm = linear.moments(folded, feats + [target], group="__fold")
        if self.method in ("lars", "lasso_lars"):
            best, scores, m = linear.lars_cv(fm, feats, target, self.method == "lasso_lars", self.scale_x, self.scale_y)
        else:
            total = linear.sum_moments(fm)
            alphas = alphas or linear.default_alpha_grid(total, len(feats), kw.get("l1_ratio", 1.0), n_alphas, scale=self.scale_x)
            best, scores = linear.cv_select(fm, len(feats), self.method, alphas, self.scale_x, self.scale_y, **kw)
            coef, b, info = linear.solve(total, len(feats), self.method, self.scale_x, self.scale_y, alpha=best, **kw)
            m = linear.LinearModel(feats, coef, b, target, info)
        m.info.update(alpha=best, cv_mse=scores)
        return m

    def fit_moments(self, mo: linear.Moments, feats: list[str], target: str) -> linear.LinearModel:
        """The model of rows with these moments of features and target."""
        return linear.fit_moments(mo, feats, target, self.method, self.scale_x, self.scale_y, **self.params)


@dataclass
class RidgeCVTrainer:
    alphas: tuple = (0.1, 1.0, 10.0)

    def fit(self, df, features, target):
        scores = linear.loo_ridge_scores(df, features, target, self.alphas)
        best = min(scores, key=lambda a: (scores[a], a))
        m = linear.fit(df, features, target, "ridge", alpha=best)
        m.info.update(alpha=best, loo_mse=scores)
        return m


@dataclass
class PolynomialModel:
    features: list
    degree: int
    linear: linear.LinearModel

    def terms(self) -> dict:
        """Products of up to ``degree`` features by name."""
        sets = [c for d in range(1, self.degree + 1) for c in combinations_with_replacement(self.features, d)]
        return {"*".join(t): t for t in sets}

    def expand(self, frame: DataFrame) -> DataFrame:
        for name, t in self.terms().items():
            if len(t) > 1:
                e = to_double(t[0])
                for f in t[1:]:
                    e = e * to_double(f)
                frame = frame.withColumn(name, e)
        return frame

    def transform(self, frame: DataFrame, out_col: str = "prediction") -> DataFrame:
        return self.linear.transform(self.expand(frame), out_col).drop(*[n for n, t in self.terms().items() if len(t) > 1])


@dataclass
class PolynomialTrainer:
    """Degree-d expansion (JVM expressions) + OLS by Gram."""
    degree: int = 2

    def fit(self, df, features, target):
        m = PolynomialModel(list(features), self.degree, None)
        m.linear = linear.fit(m.expand(df), list(m.terms()), target, "ols")
        return m


@dataclass
class RidgeClassifierTrainer:
    """+-1 target per class, ridge on standardised X from one moments pass."""
    alpha: float = 1.0

    def fit(self, df, features, target):
        feats = list(features)
        classes = native.class_list(df, target)
        ind = [F.when(col(target).cast("string") == F.lit(c), 1.0).otherwise(-1.0).alias(f"__c{i}")
               for i, c in enumerate(classes)]
        data = df.select(*[to_double(f).alias(f) for f in feats], *ind)
        mo = linear.moments(data, feats + [f"__c{i}" for i in range(len(classes))])[None]
        p = len(feats)
        sx = mo.sd_pop[:p]
        sx = np.where(sx == 0, 1.0, sx)
        G = mo.C[:p, :p] / np.outer(sx, sx)
        W, b = [], []
        for i in range(len(classes)):
            c = mo.C[:p, p + i] / sx
            w = np.linalg.solve(G + self.alpha * np.eye(p), c) / sx
            W.append(w.tolist())
            b.append(float(mo.mean[p + i] - w @ mo.mean[:p]))
        return ScoreModel(classes, feats, "linear", {"W": W, "b": b})


@dataclass
class FnTrainer:
    """Wrap a function (df, features, target) -> fitted."""
    fn: Callable

    def fit(self, df, features, target):
        return self.fn(df, list(features), target)


@dataclass
class KnnModel:
    """Neighbour model: the training rows are a table on shared storage."""
    train: DataFrame
    features: list
    target: str
    task: str
    k: int = 5
    radius: float | None = None
    weights: str = "uniform"

    def transform(self, frame: DataFrame, out_col: str = "prediction") -> DataFrame:
        rid, feats = "__rid", self.features
        q = cut_lineage(frame.withColumn(rid, F.monotonically_increasing_id()))
        points = q.select(rid, *[to_double(f).alias(f) for f in feats])
        if self.radius is not None:
            pred = neighbors.radius_regress(self.train, points, rid, feats, self.target, self.radius)
        elif self.task == "regression":
            pred = neighbors.knn_regress(self.train, points, rid, feats, self.target, self.k, self.weights)
        else:
            pred = neighbors.knn_classify(self.train, points, rid, feats, self.target, self.k)
        return q.join(pred.withColumnRenamed("prediction", out_col), rid, "left").drop(rid)


@dataclass
class KnnTrainer:
    """Rows get numbers that are fixed by a checkpoint, so equal rows stay apart and no
    column of the caller is needed as an id."""
    task: str
    k: int = 5
    radius: float | None = None
    weights: str = "uniform"

    def fit(self, df, features, target):
        train = cut_lineage(df.select(*[to_double(f).alias(f) for f in features], col(target).alias(target))
                            .withColumn("__rid", F.monotonically_increasing_id()))
        return KnnModel(train, list(features), target, self.task, self.k, self.radius, self.weights)


def _grad(task, **kw):
    return FnTrainer(lambda df, f, t: gradient.fit_gradient(df, f, t, task=task, **kw))


def _gram(method, cv=False, **defaults):
    """A builder whose parameters are those given here."""
    def build(**params):
        unknown = set(params) - set(defaults)
        if unknown:
            raise TypeError(f"unexpected parameters {sorted(unknown)}")
        given = {k: v for k, v in {**defaults, **params}.items() if v is not None}
        return GramTrainer(method, given, cv)
    build.parameters = tuple(defaults)
    return build


def _nb(fn):
    def build(**params):
        inspect.signature(fn).bind(None, None, None, **params)
        return FnTrainer(lambda df, f, t: fn(df, f, t, **params))
    build.parameters = tuple(inspect.signature(fn).parameters)[3:]
    return build


def _forest(task):
    def build(n_estimators=100, max_features="sqrt", max_depth=16, min_samples_leaf=1, criterion=None, random_state=42):
        return native.random_forest(task, n_estimators, str(max_features), random_state, max_depth, min_samples_leaf, criterion)
    return build


def _extra(task):
    def build(n_estimators=100, max_features=None, max_depth=16, min_samples_split=2, min_samples_leaf=1, random_state=42):
        return FnTrainer(lambda df, f, t: trees.extra_trees(df, f, t, task, n_estimators, max_features, max_depth,
                                                            min_samples_split, min_samples_leaf, random_state))
    return build


def _boost(task):
    def build(n_estimators=100, max_depth=3, learning_rate=0.1, max_leaf_nodes=None, min_samples_leaf=1):
        return FnTrainer(lambda df, f, t: trees.boost(df, f, t, task, n_estimators, learning_rate, max_leaf_nodes, max_depth, min_samples_leaf))
    return build


def _hist(task):
    def build(max_iter=100, max_depth=None, learning_rate=0.1, max_leaf_nodes=31, min_samples_leaf=20, l2_regularization=0.0, max_bins=255):
        return FnTrainer(lambda df, f, t: trees.boost(df, f, t, task, max_iter, learning_rate, max_leaf_nodes, max_depth,
                                                      min_samples_leaf, l2_regularization, max_bins))
    return build


def _tree(task):
    def build(max_depth=30, min_samples_leaf=1, criterion=None, random_state=42):
        return native.decision_tree(task, max_depth, random_state, min_samples_leaf, criterion)
    return build


def _bag(task):
    def build(n_estimators=10, max_depth=16, min_samples_leaf=1, random_state=42):
        return native.bagging(task, n_estimators, random_state, max_depth, min_samples_leaf)
    return build


def _ada(task):
    def build(n_estimators=50, max_depth=None, random_state=42):
        return FnTrainer(lambda df, f, t: iterative.adaboost(df, f, t, task, n_estimators, max_depth, random_state))
    return build


def _mlp(task, loss):
    def build(hidden_layer_sizes=(100,), max_iter=100, alpha=1e-4, random_state=42):
        sizes = (hidden_layer_sizes,) if isinstance(hidden_layer_sizes, int) else tuple(hidden_layer_sizes)
        return _grad(task, loss=loss, hidden=sizes, max_iter=max_iter, l2=alpha, seed=random_state)
    return build


def _svm(task, loss):
    def build(kernel="rbf", C=1.0, degree=3, gamma=None, coef0=0.0, epsilon=0.1, n_components=200, max_iter=100, random_state=42):
        return _grad(task, loss=loss, kernel=kernel, C=C, degree=degree, gamma=gamma, coef0=coef0, eps=epsilon,
                     n_components=n_components, max_iter=max_iter, seed=random_state)
    return build


def _sgd(task, loss):
    def build(loss=loss, alpha=1e-4, epsilon=0.1, max_iter=100):
        return _grad(task, loss=loss, l2=alpha, eps=epsilon, max_iter=max_iter)
    return build


def _aggressive(task, loss):
    def build(C=1.0, epsilon=0.1, max_iter=100):
        return _grad(task, loss=loss, C=C, eps=epsilon, max_iter=max_iter)
    return build


def _linear_svr(epsilon=0.0, C=1.0, max_iter=100):
    return _grad("regression", loss="epsilon_insensitive", eps=epsilon, C=C, max_iter=max_iter)


def _perceptron(max_iter=100):
    return _grad("classification", loss="perceptron", max_iter=max_iter)


def _knn(task):
    def build(n_neighbors=5, weights="uniform"):
        if weights not in ("uniform", "distance") or task == "classification" and weights != "uniform":
            raise ValueError(f"weights {weights!r} isn't offered for {task}")
        return KnnTrainer(task, n_neighbors, weights=weights)
    return build


def _radius(radius=1.0):
    return KnnTrainer("regression", radius=radius)


def _quantile(quantile=0.5, alpha=1.0, max_iter=20):
    return FnTrainer(lambda df, f, t: iterative.quantile_regression(df, f, t, quantile, alpha, max_iter))


def _ransac(max_trials=100, random_state=42):
    return FnTrainer(lambda df, f, t: iterative.ransac(df, f, t, f + [t], max_trials, random_state))


def _theil_sen(n_trials=1000, random_state=42):
    return FnTrainer(lambda df, f, t: iterative.theil_sen(df, f, t, f + [t], n_trials, random_state))


def _ridge_cv(alphas=(0.1, 1.0, 10.0)):
    return RidgeCVTrainer(tuple(alphas))


def _polynomial(degree=2):
    return PolynomialTrainer(degree)


def _ridge_classifier(alpha=1.0):
    return RidgeClassifierTrainer(alpha)


def _logistic(C=1.0, max_iter=100):
    return native.logistic(C, max_iter)


def _linear_svc(C=1.0, loss="squared_hinge", max_iter=100):
    if loss == "hinge":
        return native.linear_svc(C, max_iter)
    return _grad("classification", loss="squared_hinge", C=C, max_iter=max_iter)


def _huber(epsilon=1.35, alpha=1e-4):
    return native.huber(epsilon, alpha)


REGRESSION: dict[str, Callable[..., object]] = {
    "Linear": _gram("ols"),
    "BayesianRidge": _gram("bayesian_ridge"),
    "ARDRegression": _gram("ard"),
    "Ridge": _gram("ridge", alpha=1.0, positive=None),
    "Lasso": _gram("lasso", alpha=1.0, positive=None),
    "ElasticNet": _gram("elasticnet", alpha=1.0, l1_ratio=0.5),
    "SVM": _svm("regression", "epsilon_insensitive"),
    "RF": _forest("regression"),
    "ExtraTrees": _extra("regression"),
    "MLP": _mlp("regression", "squared"),
    "K-Nearest": _knn("regression"),
    "gradient_boosting": _boost("regression"),
    "AdaBoost": _ada("regression"),
    "Bagging": _bag("regression"),
    "DecisionTree": _tree("regression"),
    "ElasticNetCV": _gram("elasticnet", cv=True, l1_ratio=0.5, alphas=None, n_alphas=100, folds=5),
    "HistGradientBoosting": _hist("regression"),
    "Huber": _huber,
    "LARS": _gram("lars", n_nonzero_coefs=500),
    "LARSCV": _gram("lars", cv=True, folds=5),
    "LassoCV": _gram("lasso", cv=True, alphas=None, n_alphas=100, folds=5, positive=None),
    "LassoLars": _gram("lasso_lars", alpha=1.0),
    "LassoLarsCV": _gram("lasso_lars", cv=True, folds=5),
    "LinearSVR": _linear_svr,
    "OMP": _gram("omp", n_nonzero_coefs=None),
    "PassiveAggressive": _aggressive("regression", "pa_epsilon"),
    "Quantile": _quantile,
    "RadiusNeighbors": _radius,
    "RANSAC": _ransac,
    "RidgeCV": _ridge_cv,
    "SGD": _sgd("regression", "squared"),
    "TheilSen": _theil_sen,
    "Polynomial": _polynomial,
    "Perceptron": _perceptron,
}

CLASSIFICATION: dict[str, Callable[..., object]] = {
    "Logistic_classifier": _logistic,
    "ExtraTrees_classifier": _extra("classification"),
    "GaussianNB_classifier": _nb(bayes.fit_gaussian_nb),
    "SGD_classifier": _sgd("classification", "hinge"),
    "MLP_classifier": _mlp("classification", "softmax"),
    "RF_classifier": _forest("classification"),
    "SVC_classifier": _svm("classification", "hinge"),
    "AdaBoost_classifier": _ada("classification"),
    "Bagging_classifier": _bag("classification"),
    "BernoulliNB_classifier": _nb(bayes.fit_bernoulli_nb),
    "CategoricalNB_classifier": _nb(bayes.fit_categorical_nb),
    "ComplementNB_classifier": _nb(bayes.fit_complement_nb),
    "DecisionTree_classifier": _tree("classification"),
    "GradientBoosting_classifier": _boost("classification"),
    "HistGradientBoosting_classifier": _hist("classification"),
    "KNeighbors_classifier": _knn("classification"),
    "LDA_classifier": _nb(bayes.fit_lda),
    "LinearSVC_classifier": _linear_svc,
    "MultinomialNB_classifier": _nb(bayes.fit_multinomial_nb),
    "PassiveAggressive_classifier": _aggressive("classification", "pa_hinge"),
    "QDA_classifier": _nb(bayes.fit_qda),
    "Ridge_classifier": _ridge_classifier,
}

# Known keys without a Spark form; ``make`` raises for them.
UNSUPPORTED = {
    "NuSVR": ("regression", "a dense nu-SVM solver; SVM offers the epsilon form"),
    "NuSVC_classifier": ("classification", "a dense nu-SVM solver; SVC_classifier offers the C form"),
    "affinity_propagation": ("cluster", "messages between all pairs of rows"),
    "optics": ("cluster", "a sequential ordering of all rows; dbscan has a distributed form"),
    "hdbscan": ("cluster", "a tree over all pairs of rows; dbscan has a distributed form"),
}


def _cluster_fn(name):
    def run(df: DataFrame, feats: Sequence[str], k: int = 8, id_col: str | None = None, seed: int = 42):
        if name == "kmeans":
            return cluster.kmeans(df, feats, k, seed)
        if name == "minibatch_kmeans":
            return cluster.minibatch_kmeans(df, feats, k, seed)
        if name == "bisecting_kmeans":
            return cluster.bisecting_kmeans(df, feats, k, seed)
        if name == "gmm":
            return cluster.gaussian_mixture(df, feats, k, seed)
        if name == "agglo":
            return cluster.agglomerative(df, feats, k)
        if name == "birch":
            return cluster.birch(df, feats, k)
        if name == "meanshift":
            return cluster.mean_shift(df, feats)
        if name == "spectral":
            return cluster.spectral(df, id_col, feats, k)
        if name == "dbscan":
            return neighbors.dbscan(df, id_col, feats)
        raise KeyError(name)
    return run


CLUSTERING = {k: (lambda k=k: _cluster_fn(k)) for k in (
    "kmeans", "gmm", "agglo", "dbscan", "birch", "spectral", "bisecting_kmeans", "meanshift", "minibatch_kmeans")}


def problem_type(key: str) -> str:
    for kind, registry in (("regression", REGRESSION), ("classification", CLASSIFICATION), ("cluster", CLUSTERING)):
        if key in registry:
            return kind
    if key in UNSUPPORTED:
        return UNSUPPORTED[key][0]
    raise KeyError(key)


def parameters(key: str) -> tuple[str, ...]:
    """Names of the hyper-parameters that ``make`` takes for a model."""
    build = {**REGRESSION, **CLASSIFICATION, **CLUSTERING}[key]
    return getattr(build, "parameters", None) or tuple(p for p in inspect.signature(build).parameters if key not in CLUSTERING)


def make(key: str, params: dict | None = None, prescaled: bool = False):
    """The trainer of a model. ``prescaled``: the caller has applied the chosen scaler,
    so Gram models don't standardise again."""
    if key in UNSUPPORTED:
        raise NotImplementedError(f"{key} needs {UNSUPPORTED[key][1]}")
    for registry in (REGRESSION, CLASSIFICATION, CLUSTERING):
        if key in registry:
            try:
                trainer = registry[key](**(params or {}))
            except TypeError as e:
                raise ValueError(f"{key}: {e}; it takes {', '.join(parameters(key)) or 'no parameters'}") from e
            if prescaled and isinstance(trainer, GramTrainer):
                trainer.scale_x = trainer.scale_y = False
            return trainer
    raise KeyError(f"unknown model {key!r}")


def registry_table(spark) -> DataFrame:
    rows = [(k, problem_type(k), UNSUPPORTED[k][1] if k in UNSUPPORTED else None)
            for k in [*REGRESSION, *CLASSIFICATION, *CLUSTERING, *UNSUPPORTED]]
    return spark.createDataFrame(rows, "model string, problem_type string, note string")
