"""Gradient-trained models on all rows, in step.

Every step is one pass: tasks go through their partition in Arrow batches, keep only a
model-sized sum of gradients, and return one row each; the sums meet in at most
``FAN_IN`` rows before the driver adds them up and moves the parameters. The
optimiser's state lives on the driver, so the model is that of all rows whatever
their partitioning (up to the rounding of sums).

* Losses (squared, log loss, hinge, squared hinge, epsilon-insensitive) and networks with
  them: limited-memory quasi-Newton steps with backtracking. Kinks of the hinge and
  the epsilon-insensitive loss are rounded off over a width of ``ROUND``, so that the
  least objective is one point that rounding errors can't move.
* Passive-aggressive: every example's closed-form step at the current parameters,
  bounded by C, averaged over all rows. Perceptron: the mean correction of the rows
  that are wrong. Both return the best parameters on the way.
* Kernels: ``linear`` is the identity; ``rbf`` uses random Fourier features; ``poly``
  a tensor sketch (count sketches of the input multiplied in the frequency domain).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from quarry.functions.exprs import col, to_double
from quarry.operators.native import class_list

FAN_IN = 32
BATCH = 4096
ROUND = 0.05
STEPPED = ("pa_hinge", "pa_epsilon", "perceptron")

# ------------------------------------------------------------------ kernels


@dataclass
class FeatureMap:
    """Explicit features of a kernel; ``arrays`` are plain lists, so that a model can be
    saved as a document."""
    kind: str = "linear"
    arrays: dict = field(default_factory=dict)

    def __call__(self, Z: np.ndarray) -> np.ndarray:
        if self.kind == "linear":
            return Z
        if self.kind == "rbf":
            Om, be = np.array(self.arrays["frequency"]), np.array(self.arrays["phase"])
            return math.sqrt(2.0 / len(be)) * np.cos(Z @ Om + be)
        # poly: count sketches of (sqrt(gamma) z, sqrt(coef0)), one for each factor
        a = self.arrays
        Z1 = np.column_stack((math.sqrt(a["gamma"]) * Z, np.full(len(Z), math.sqrt(a["coef0"]))))
        out = 1.0
        for place, sign in zip(np.array(a["place"]), np.array(a["sign"])):
            S = np.zeros((Z1.shape[1], a["size"]))
            S[np.arange(len(place)), place] = sign
            out = out * np.fft.rfft(Z1 @ S, axis=1)
        return np.fft.irfft(out, n=a["size"], axis=1)


def feature_map(kernel: str, p: int, size: int = 200, gamma: float | None = None, degree: int = 3, coef0: float = 0.0,
                seed: int = 42) -> FeatureMap:
    """The map of a kernel on ``p`` standardised inputs; ``gamma`` defaults to 1 / p."""
    rng = np.random.default_rng(seed)
    g = 1.0 / p if gamma is None else gamma
    if kernel == "linear":
        return FeatureMap()
    if kernel == "rbf":
        return FeatureMap("rbf", {"frequency": rng.normal(0, math.sqrt(2 * g), (p, size)).tolist(),
                                  "phase": rng.uniform(0, 2 * math.pi, size).tolist()})
    if kernel == "poly":
        if g < 0 or coef0 < 0 or degree < 1:
            raise ValueError("the polynomial kernel needs gamma >= 0, coef0 >= 0 and degree >= 1")
        return FeatureMap("poly", {"gamma": float(g), "coef0": float(coef0), "size": int(size),
                                   "place": rng.integers(0, size, (degree, p + 1)).tolist(),
                                   "sign": rng.choice([-1.0, 1.0], (degree, p + 1)).tolist()})
    raise ValueError(f"unknown kernel {kernel!r}; linear, rbf and poly are offered")


# ------------------------------------------------------------------ objective


def init_params(p: int, k: int, hidden: Sequence[int], seed: int) -> list:
    """Weights and intercepts layer by layer; a model without hidden layers starts at zero."""
    if not hidden:
        return [np.zeros((p, k)), np.zeros(k)]
    rng = np.random.default_rng(seed)
    sizes = [p, *hidden, k]
    out = []
    for a, b in zip(sizes, sizes[1:]):
        out += [rng.normal(0, math.sqrt(2.0 / a), (a, b)), np.zeros(b)]
    return out


def forward(params: list, X: np.ndarray) -> list:
    """Inputs of every layer, then the output."""
    out = [X]
    for k in range(0, len(params), 2):
        z = out[-1] @ params[k] + params[k + 1]
        out.append(np.maximum(z, 0.0) if k + 2 < len(params) else z)
    return out


def _rounded(over: np.ndarray):
    """max(over, 0) with a rounded kink, and its slope."""
    inside = np.clip(over, 0.0, ROUND)
    return inside ** 2 / (2 * ROUND) + np.maximum(over - ROUND, 0.0), inside / ROUND


def loss_sums(params: list, X: np.ndarray, Y: np.ndarray, loss: str, eps: float = 0.1, C: float = 1.0):
    """Sum of losses of a batch and of their derivatives by every parameter. For the
    passive-aggressive and perceptron losses the derivative is minus each example's own step."""
    layers = forward(params, X)
    out = layers[-1]
    if loss == "squared":
        r = out - Y
        value, G = 0.5 * (r ** 2).sum(), r
    elif loss in ("epsilon_insensitive", "pa_epsilon"):
        r = out - Y
        if loss == "pa_epsilon":
            over = np.maximum(np.abs(r) - eps, 0.0)
            value, G = over.sum(), np.sign(r) * np.minimum(C, over / ((X ** 2).sum(axis=1) + 1.0)[:, None])
        else:
            over, slope = _rounded(np.abs(r) - eps)
            value, G = over.sum(), np.sign(r) * slope
    elif loss == "hinge":
        short, slope = _rounded(1.0 - Y * out)
        value, G = short.sum(), -Y * slope
    elif loss == "perceptron":
        # a tie is a mistake too, or nothing would beat the zero start
        wrong = Y * out <= 0
        value, G = wrong.sum(), -Y * wrong
    elif loss in ("squared_hinge", "pa_hinge"):
        short = np.maximum(1.0 - Y * out, 0.0)
        if loss == "squared_hinge":
            value, G = (short ** 2).sum(), -2 * Y * short
        else:
            value, G = short.sum(), -Y * np.minimum(C, short / ((X ** 2).sum(axis=1) + 1.0)[:, None])
    elif loss == "softmax":
        z = out - out.max(axis=1, keepdims=True)
        P = np.exp(z)
        total = P.sum(axis=1, keepdims=True)
        value = (np.log(total)[:, 0] - (z * Y).sum(axis=1)).sum()
        G = P / total - Y
    else:
        raise ValueError(f"unknown loss {loss!r}")
    grads = [None] * len(params)
    for k in range(len(params) - 2, -1, -2):
        grads[k], grads[k + 1] = layers[k // 2].T @ G, G.sum(axis=0)
        if k:
            G = (G @ params[k].T) * (layers[k // 2] > 0)
    return float(value), grads


def _flat(arrays: list) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays])


def _shaped(flat: np.ndarray, like: list) -> list:
    cuts = np.cumsum([a.size for a in like])[:-1]
    return [part.reshape(a.shape) for part, a in zip(np.split(flat, cuts), like)]


# ------------------------------------------------------------------ optimisers


def lbfgs(evaluate, w: np.ndarray, max_iter: int, tol: float = 1e-6, memory: int = 10) -> np.ndarray:
    """Least objective by quasi-Newton steps; ``evaluate(w)`` gives value and gradient
    (one pass over the data)."""
    value, grad = evaluate(w)
    pairs: list = []
    for _ in range(max_iter):
        if np.abs(grad).max(initial=0.0) <= tol * max(1.0, np.abs(w).max(initial=0.0)):
            break
        q, alphas = grad.copy(), []
        for s, y in reversed(pairs):
            alphas.append(s @ q / (s @ y))
            q -= alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas)):
            q += (a - y @ q / (s @ y)) * s
        step = 1.0 if pairs else min(1.0, 1.0 / np.abs(grad).sum())
        slope = -(q @ grad)
        if slope >= 0:
            q, slope, pairs = grad.copy(), -(grad @ grad), []
        for _ in range(20):
            new = w - step * q
            new_value, new_grad = evaluate(new)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - w, new_grad - grad
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-memory:]
        done = value - new_value <= 1e-10 * max(1.0, abs(value))
        w, value, grad = new, new_value, new_grad
        if done:
            break
    return w


def averaged_steps(evaluate, w: np.ndarray, max_iter: int) -> np.ndarray:
    """Mean steps of all examples; the parameters of least mean loss are returned."""
    best, best_value = w, math.inf
    for _ in range(max_iter):
        value, step = evaluate(w)
        if value < best_value:
            best, best_value = w, value
        if value == 0.0:
            break
        w = w - step
    value, _ = evaluate(w)
    return w if value < best_value else best


# ------------------------------------------------------------------ model


@dataclass
class GradientModel:
    features: list
    params: list
    classes: list | None
    scale: tuple = field(default_factory=tuple)  # mean and sd of the inputs
    yscale: tuple = (0.0, 1.0)                   # and of a regression target
    map_kind: str = "linear"
    map_arrays: dict = field(default_factory=dict)

    def design(self, X: np.ndarray) -> np.ndarray:
        mu, sd = (np.asarray(a, float) for a in self.scale)
        return FeatureMap(self.map_kind, self.map_arrays)((X - mu) / sd)

    def transform(self, df: DataFrame, out_col: str = "prediction") -> DataFrame:
        """Rows with a missing feature get no prediction."""
        params, classes, design = [np.asarray(a, float) for a in self.params], self.classes, self.design
        ym, ys = self.yscale

        @F.pandas_udf("double")
        def score(*cols: pd.Series) -> pd.Series:
            X = np.column_stack([c.to_numpy(float) for c in cols])
            out = forward(params, design(X))[-1]
            best = out[:, 0] * ys + ym if classes is None else np.argmax(out, axis=1).astype(float)
            return pd.Series(np.where(np.isfinite(X).all(axis=1), best, np.nan))

        s = score(*[to_double(f) for f in self.features])
        s = F.when(F.isnan(s), None).otherwise(s)
        if classes is None:
            return df.withColumn(out_col, s)
        name = F.element_at(F.array(*[F.lit(c) for c in classes]), s.cast("int") + 1)
        return df.withColumn(out_col, F.when(s.isNotNull(), name))


def _data(df: DataFrame, feats: Sequence[str], target: str, classes: list | None) -> DataFrame:
    y = to_double(target)
    if classes:
        y = (F.array_position(F.array(*[F.lit(c) for c in classes]), col(target).cast("string")) - 1).cast("double")
    xs = [to_double(f) for f in feats]
    good = F.abs(y) < float("inf")
    for x in xs:
        good = good & (F.abs(x) < float("inf"))
    return df.where(good).select(*[x.alias(f"f{i}") for i, x in enumerate(xs)], y.alias("y"))


def _pass(data: DataFrame, n_parts: int, model: GradientModel, params: list, loss: str, eps: float, C: float):
    """(sum of losses, flat sum of gradients) over all rows."""
    sent = data.sparkSession.sparkContext.broadcast((model, params))
    p, k = len(model.features), params[-1].size
    codes = bool(model.classes)
    ym, ys = model.yscale

    def run(batches):
        model, params = sent.value
        total, value = np.zeros(sum(a.size for a in params)), 0.0
        for batch in batches:
            table = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for a in range(0, len(table), BATCH):
                X, y = table[a:a + BATCH, :p], table[a:a + BATCH, p]
                if codes:
                    Y = np.eye(k)[y.astype(int)]
                    Y = Y if loss == "softmax" else 2 * Y - 1
                else:
                    Y = ((y - ym) / ys)[:, None]
                v, grads = loss_sums(params, model.design(X), Y, loss, eps, C)
                value += v
                total += _flat(grads)
        yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([total.tobytes()], pa.binary())], ["value", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in table.column("total").to_pylist())
        return pa.table({"value": [sum(table.column("value").to_pylist())], "total": pa.array([total.tobytes()], pa.binary())})
    rows = data.mapInArrow(run, "value double, total binary")
    if n_parts > FAN_IN:
        rows = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(FAN_IN))).applyInArrow(add, "value double, total binary")
    rows = rows.collect()
    sent.unpersist()
    return sum(r["value"] for r in rows), sum(np.frombuffer(bytes(r["total"])) for r in rows)


def fit_gradient(df: DataFrame, features: Sequence[str], target: str, task: str = "regression", loss: str = "squared",
                 hidden: Sequence[int] = (), max_iter: int = 100, eps: float = 0.1, l2: float = 1e-4,
                 C: float | None = None, kernel: str = "linear", n_components: int = 200, gamma: float | None = None,
                 degree: int = 3, coef0: float = 0.0, seed: int = 42) -> GradientModel:
    """A model of least mean loss plus ``l2 / 2`` times the squared weights, on
    standardised inputs (and a standardised regression target). ``C``: sets l2 to
    1 / (C n); for passive-aggressive losses it bounds every step instead."""
    feats = list(features)
    p = len(feats)
    classes = class_list(df, target) if task == "classification" else None
    data = _data(df, feats, target, classes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        st = data.agg(F.count(F.lit(1)).alias("n"), *[x for i in range(p) for x in (F.avg(f"f{i}").alias(f"m{i}"), F.stddev_pop(f"f{i}").alias(f"s{i}"))],
                      F.avg("y").alias("ym"), F.stddev_pop("y").alias("ys")).first()
        n = st["n"]
        if not n:
            raise ValueError("no row has a target and all features")
        mu, sd = [st[f"m{i}"] for i in range(p)], [st[f"s{i}"] or 1.0 for i in range(p)]
        yscale = (0.0, 1.0) if classes else (st["ym"], st["ys"] or 1.0)
        fmap = feature_map(kernel, p, n_components, gamma, degree, coef0, seed)
        model = GradientModel(feats, [], classes, (mu, sd), yscale, fmap.kind, fmap.arrays)
        start = init_params(p if kernel == "linear" else n_components, len(classes) if classes else 1, hidden, seed)
        bound = 1.0 if C is None else C
        if C is not None and loss not in STEPPED:
            l2 = 1.0 / (C * n)
        heavy = _flat([np.full(a.shape, float(k % 2 == 0)) for k, a in enumerate(start)])  # intercepts go free
        n_parts = data.rdd.getNumPartitions()

        def evaluate(w):
            value, grad = _pass(data, n_parts, model, _shaped(w, start), loss, eps, bound)
            if loss in STEPPED:
                return value / n, grad / n
            return value / n + l2 / 2 * float((heavy * w) @ w), grad / n + l2 * heavy * w
        w = (averaged_steps if loss in STEPPED else lbfgs)(evaluate, _flat(start), max_iter)
    finally:
        data.unpersist()
    model.params = [a.tolist() for a in _shaped(w, start)]
    return model
