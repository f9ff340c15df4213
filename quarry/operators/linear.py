"""Linear models from sufficient statistics ("Gram family", R1-R15, C2).

One aggregation pass returns, per group (fold, class, seed, ...), the row
count, column means and the centered co-moment matrix (n * covar_pop) of
features and targets. Everything else is p x p numpy on the driver:

* OLS, Ridge: a linear solve;
* Lasso / ElasticNet: coordinate descent on the Gram;
* BayesianRidge / ARD: evidence updates from the Gram's eigen-decomposition;
* OMP, LARS, LassoLars: greedy / path algorithms on the Gram;
* k-fold CV: fold moments come from one ``groupBy(fold)``; the training part
  of each fold is (total - fold), combined exactly (Chan's formula).

Standardising X and y (what the reference does before fitting) is a rescale
of these matrices, so it costs no extra pass. Prediction is a JVM column
expression ``b + sum(w_j * x_j)``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import combinations_with_replacement
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.exprs import col, to_double

WIDE_P = 48  # above this many columns the co-moments come from mapInPandas


# ----------------------------------------------------------------- moments

@dataclass
class Moments:
    n: float
    mean: np.ndarray
    C: np.ndarray  # centered co-moment sums, (k x k)

    def combine(self, o: "Moments") -> "Moments":
        n = self.n + o.n
        if n == 0:
            return self
        d = o.mean - self.mean
        mean = self.mean + d * (o.n / n)
        C = self.C + o.C + np.outer(d, d) * (self.n * o.n / n)
        return Moments(n, mean, C)

    def minus(self, part: "Moments") -> "Moments":
        """Moments of (self without part); exact inverse of ``combine``."""
        n = self.n - part.n
        if n <= 0:
            return Moments(0.0, np.zeros_like(self.mean), np.zeros_like(self.C))
        mean = (self.mean * self.n - part.mean * part.n) / n
        d = part.mean - mean
        C = self.C - part.C - np.outer(d, d) * (part.n * n / self.n)
        return Moments(n, mean, C)

    def of(self, at: Sequence[int]) -> "Moments":
        """Those of some of the columns."""
        return Moments(self.n, self.mean[list(at)], self.C[np.ix_(at, at)])

    def rescaled(self, center: Sequence[float], scale: Sequence[float]) -> "Moments":
        """Those of (x - center) / scale."""
        c, s = np.asarray(center, float), np.asarray(scale, float)
        return Moments(self.n, (self.mean - c) / s, self.C / np.outer(s, s))

    @property
    def cov_pop(self) -> np.ndarray:
        return self.C / self.n if self.n else self.C * np.nan

    @property
    def sd_pop(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.C) / self.n, 0.0)) if self.n else self.mean * np.nan


def moments(df: DataFrame, cols: Sequence[str], group: str | None = None) -> dict:
    """{group_value: Moments} over rows where every column is present."""
    cols = list(cols)
    k = len(cols)
    xs = [to_double(c) for c in cols]
    present = F.lit(True)
    for x in xs:
        present = present & x.isNotNull()
    data = df.where(present)
    if k > WIDE_P:
        return _moments_wide(data, cols, group)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)]
    pairs = list(combinations_with_replacement(range(k), 2))
    aggs += [F.covar_pop(xs[i], xs[j]).alias(f"c{i}_{j}") for i, j in pairs]
    rows = (data.groupBy(col(group).alias("__g")).agg(*aggs).collect() if group
            else [data.agg(*aggs).first()])
    out = {}
    for r in rows:
        n = float(r["n"] or 0)
        mean = np.array([r[f"m{i}"] if r[f"m{i}"] is not None else np.nan for i in range(k)], float)
        C = np.zeros((k, k))
        for i, j in pairs:
            v = r[f"c{i}_{j}"]
            C[i, j] = C[j, i] = (v if v is not None else 0.0) * n
        out[r["__g"] if group else None] = Moments(n, mean, C)
    return out


def _moments_wide(data: DataFrame, cols: list[str], group: str | None) -> dict:
    """Wide tables: per-partition numpy cross-products of mean-shifted values,
    emitted as (group, i, j, value) rows and summed by Spark, so the driver
    receives p(p+1)/2 + p + 1 numbers per group whatever the partition count.
    Shifting by the global column means keeps the raw sums well conditioned."""
    k = len(cols)
    xs = [to_double(c).alias(f"x{i}") for i, c in enumerate(cols)]
    shift_row = data.agg(*[F.avg(to_double(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    shift = np.array([shift_row[f"m{i}"] or 0.0 for i in range(k)])
    gcol = col(group).cast("string") if group else F.lit(None).cast("string")
    sel = data.select(gcol.alias("__g"), *xs)
    iu, ju = np.triu_indices(k)

    def part(it):
        import pandas as pd
        acc: dict = {}
        for pdf in it:
            for g, sub in pdf.groupby("__g", dropna=False):
                X = sub[[f"x{i}" for i in range(k)]].to_numpy(float) - shift
                n, sx, sxx = acc.get(g, (0.0, np.zeros(k), np.zeros((k, k))))
                acc[g] = (n + len(X), sx + X.sum(0), sxx + X.T @ X)
        for g, (n, sx, sxx) in acc.items():
            gv = None if (isinstance(g, float) and np.isnan(g)) else g
            ii = np.concatenate([[-1], -np.ones(k, int) - 1, iu])
            jj = np.concatenate([[-1], np.arange(k), ju])
            vv = np.concatenate([[n], sx, sxx[iu, ju]])
            yield pd.DataFrame({"__g": [gv] * len(vv), "i": ii, "j": jj, "v": vv})

    sums = (sel.mapInPandas(part, "__g string, i long, j long, v double")
            .groupBy("__g", "i", "j").agg(F.sum("v").alias("v")).toPandas())  # p^2 rows per group
    out: dict = {}
    for g, grp in sums.groupby("__g", dropna=False):
        gv = None if (isinstance(g, float) and np.isnan(g)) else g
        n = float(grp[(grp.i == -1) & (grp.j == -1)].v.sum())
        sx = np.zeros(k)
        row = grp[grp.i == -2]
        sx[row.j.to_numpy(int)] = row.v.to_numpy()
        sxx = np.zeros((k, k))
        cr = grp[grp.i >= 0]
        sxx[cr.i.to_numpy(int), cr.j.to_numpy(int)] = cr.v.to_numpy()
        sxx = np.triu(sxx) + np.triu(sxx, 1).T
        mean_shifted = sx / n if n else sx
        C = sxx - n * np.outer(mean_shifted, mean_shifted)
        out[gv] = Moments(n, mean_shifted + shift, C)
    return out


# ----------------------------------------------------------------- solvers

def _soft(x: float, t: float) -> float:
    return np.sign(x) * max(abs(x) - t, 0.0)


def coordinate_descent(G: np.ndarray, c: np.ndarray, n: float, alpha: float, l1_ratio: float = 1.0,
                       max_iter: int = 1000, tol: float = 1e-4, positive: bool = False,
                       w0: np.ndarray | None = None) -> np.ndarray:
    """min 1/(2n)||y - Xw||^2 + a*r*|w|_1 + a*(1-r)/2*|w|^2 on centered Gram."""
    p = len(c)
    w = np.zeros(p) if w0 is None else w0.copy()
    l1, l2 = alpha * l1_ratio * n, alpha * (1 - l1_ratio) * n
    diag = np.diag(G)
    for _ in range(max_iter):
        w_max = d_max = 0.0
        for j in range(p):
            if diag[j] == 0:
                continue
            rho = c[j] - G[j] @ w + diag[j] * w[j]
            new = _soft(rho, l1) / (diag[j] + l2)
            if positive and new < 0:
                new = 0.0
            d_max = max(d_max, abs(new - w[j]))
            w[j] = new
            w_max = max(w_max, abs(new))
        if w_max == 0 or d_max / w_max < tol:
            break
    return w


def bayesian_ridge(G, c, yy, n, max_iter=300, tol=1e-3, a1=1e-6, a2=1e-6, l1=1e-6, l2=1e-6):
    """Evidence maximisation using only the Gram (eigenvalues) and X'y."""
    eig, V = np.linalg.eigh(G)
    eig = np.maximum(eig, 0)
    Vc = V.T @ c
    var_y = yy / n
    alpha = 1.0 / (var_y + np.finfo(float).eps)
    lam = 1.0
    w_old = None
    for _ in range(max_iter):
        w = V @ (Vc / (eig + lam / alpha))
        rss = yy - 2 * w @ c + w @ G @ w
        gamma = np.sum(alpha * eig / (lam + alpha * eig))
        lam = (gamma + 2 * l1) / (np.sum(w ** 2) + 2 * l2)
        alpha = (n - gamma + 2 * a1) / (rss + 2 * a2)
        if w_old is not None and np.sum(np.abs(w_old - w)) < tol:
            break
        w_old = w
    w = V @ (Vc / (eig + lam / alpha))
    return w, alpha, lam


def ard(G, c, yy, n, max_iter=300, tol=1e-3, a1=1e-6, a2=1e-6, l1=1e-6, l2=1e-6, threshold=1e4):
    p = len(c)
    alpha = 1.0 / (yy / n + np.finfo(float).eps)
    lam = np.ones(p)
    keep = np.ones(p, bool)
    w = np.zeros(p)
    w_old = None
    for _ in range(max_iter):
        idx = np.where(keep)[0]
        Gk = G[np.ix_(idx, idx)]
        sigma = np.linalg.pinv(np.diag(lam[idx]) + alpha * Gk)
        w = np.zeros(p)
        w[idx] = alpha * sigma @ c[idx]
        rss = yy - 2 * w @ c + w @ G @ w
        gamma = 1 - lam[idx] * np.diag(sigma)
        lam[idx] = (gamma + 2 * l1) / (w[idx] ** 2 + 2 * l2)
        alpha = (n - gamma.sum() + 2 * a1) / (rss + 2 * a2)
        keep = lam < threshold
        w[~keep] = 0
        if w_old is not None and np.sum(np.abs(w_old - w)) < tol:
            break
        w_old = w
    return w


def omp(G, c, n_nonzero: int | None = None):
    p = len(c)
    k = n_nonzero or max(int(0.1 * p), 1)
    active: list[int] = []
    w = np.zeros(p)
    for _ in range(min(k, p)):
        corr = c - G @ w
        cand = [j for j in range(p) if j not in active]
        if not cand:
            break
        j = max(cand, key=lambda t: abs(corr[t]))
        active.append(j)
        sol = np.linalg.lstsq(G[np.ix_(active, active)], c[active], rcond=None)[0]
        w = np.zeros(p)
        w[active] = sol
    return w


def lars_path(G, c, n, lasso: bool = False, max_steps: int | None = None, alpha_min: float = 0.0):
    """Least-angle regression path on the Gram (lasso modification optional).

    Returns the list of (alpha, coef) breakpoints, alpha = max|corr| / n.
    """
    p = len(c)
    max_steps = max_steps or p
    w = np.zeros(p)
    active: list[int] = []
    path = [(np.max(np.abs(c)) / n if p else 0.0, w.copy())]
    for _ in range(8 * p):
        corr = c - G @ w
        C_ = np.max(np.abs(corr)) if p else 0.0
        if C_ / n <= alpha_min + 1e-15 or len(active) >= min(max_steps, p) and not lasso:
            break
        if not active or len(active) < p:
            inactive = [j for j in range(p) if j not in active]
            if inactive and (not active or max(abs(corr[j]) for j in inactive) >= C_ - 1e-12):
                j = max(inactive, key=lambda t: abs(corr[t]))
                if j not in active:
                    active.append(j)
        A = active
        s = np.sign(corr[A])
        GA = G[np.ix_(A, A)]
        try:
            GAi = np.linalg.pinv(GA)
        except np.linalg.LinAlgError:
            break
        u = GAi @ s
        AA = 1.0 / np.sqrt(max(s @ u, 1e-300))
        dirA = AA * u
        a = G[:, A] @ dirA
        gam = C_ / AA
        for j in range(p):
            if j in A:
                continue
            for num, den in ((C_ - corr[j], AA - a[j]), (C_ + corr[j], AA + a[j])):
                if den > 1e-15:
                    g = num / den
                    if 1e-15 < g < gam:
                        gam = g
        drop = None
        if lasso:
            for t, j in enumerate(A):
                if dirA[t] != 0:
                    g = -w[j] / dirA[t]
                    if 1e-15 < g < gam:
                        gam, drop = g, j
        if alpha_min > 0 and (C_ - gam * AA) / n < alpha_min:
            gam = (C_ - alpha_min * n) / AA
        w_new = w.copy()
        w_new[A] += gam * dirA
        w = w_new
        if drop is not None:
            w[drop] = 0.0
            active.remove(drop)
        path.append((max((C_ - gam * AA) / n, 0.0), w.copy()))
        if (C_ - gam * AA) / n <= alpha_min + 1e-15:
            break
        if not lasso and len(active) >= min(max_steps, p):
            corr = c - G @ w
            path.append((np.max(np.abs(corr)) / n, w.copy()))
            break
    return path


# ----------------------------------------------------------------- model

@dataclass
class LinearModel:
    features: list[str]
    coef: np.ndarray
    intercept: float
    target: str = "y"
    info: dict = field(default_factory=dict)

    def predict_expr(self, forced: dict[str, float] | None = None) -> Column:
        """The prediction; features in ``forced`` have that value on every row."""
        forced = forced or {}
        e = F.lit(float(self.intercept))
        for f, w in zip(self.features, self.coef):
            e = e + F.lit(float(w)) * (F.lit(float(forced[f])) if f in forced else to_double(f))
        return e

    def transform(self, df: DataFrame, out_col: str = "prediction") -> DataFrame:
        return df.withColumn(out_col, self.predict_expr())

    def to_json(self) -> str:
        return json.dumps({"kind": "linear", "features": self.features, "coef": list(map(float, self.coef)),
                           "intercept": float(self.intercept), "target": self.target})

    @staticmethod
    def from_json(s: str) -> "LinearModel":
        d = json.loads(s)
        return LinearModel(d["features"], np.array(d["coef"]), d["intercept"], d["target"])


def predict_by(df: DataFrame, fitted: Sequence[dict[int, LinearModel]], by: str) -> tuple[DataFrame, list[Column]]:
    """``df`` joined with the models that the numbers in its int column ``by`` name, and per dict
    of models the prediction. Rows without a model go. The joined table has a row per number."""
    names = [[f"__w{i}_{j}" for j in range(len(next(iter(ms.values())).features) + 1)] for i, ms in enumerate(fitted)]
    rows = [(k, *[float(v) for ms in fitted for v in (ms[k].intercept, *ms[k].coef)]) for k in fitted[0]]
    table = df.sparkSession.createDataFrame(rows, f"{by} int, " + ", ".join(f"{n} double" for of in names for n in of))
    preds = []
    for of, ms in zip(names, fitted):
        e = F.col(of[0])
        for n, f in zip(of[1:], next(iter(ms.values())).features):
            e = e + F.col(n) * to_double(f)
        preds.append(e)
    return df.join(F.broadcast(table), by), preds


def _scaled_system(mo: Moments, p: int, scale_x: bool, scale_y: bool):
    """Centered Gram and X'y (optionally standardised by population sd)."""
    G = mo.C[:p, :p].copy()
    c = mo.C[:p, p].copy()
    yy = mo.C[p, p]
    sx = mo.sd_pop[:p] if scale_x else np.ones(p)
    sx = np.where(sx == 0, 1.0, sx)
    sy = mo.sd_pop[p] if scale_y else 1.0
    sy = 1.0 if sy == 0 else sy
    G = G / np.outer(sx, sx)
    c = c / (sx * sy)
    yy = yy / (sy * sy)
    return G, c, yy, sx, sy


def solve(mo: Moments, p: int, method: str = "ols", scale_x: bool = True, scale_y: bool = True,
          **kw) -> tuple[np.ndarray, float, dict]:
    """Fit on moments of [x_1..x_p, y]; returns coef (original units), intercept, info."""
    G, c, yy, sx, sy = _scaled_system(mo, p, scale_x, scale_y)
    n = mo.n
    info: dict = {}
    if method in ("ols", "linear", "polynomial"):
        w = np.linalg.lstsq(G, c, rcond=None)[0]
    elif method == "ridge":
        w = np.linalg.solve(G + kw.get("alpha", 1.0) * np.eye(p), c) if p else np.zeros(0)
        if kw.get("positive"):
            # ||y - Xw||^2 + a ||w||^2 is 2n times the descent's objective at a / n
            w = coordinate_descent(G, c, n, kw.get("alpha", 1.0) / n, 0.0, positive=True) if p else w
    elif method == "lasso":
        w = coordinate_descent(G, c, n, kw.get("alpha", 1.0), 1.0, positive=kw.get("positive", False))
    elif method == "elasticnet":
        w = coordinate_descent(G, c, n, kw.get("alpha", 1.0), kw.get("l1_ratio", 0.5))
    elif method == "bayesian_ridge":
        w, a, lam = bayesian_ridge(G, c, yy, n)
        info.update(alpha=a, lambda_=lam)
    elif method == "ard":
        w = ard(G, c, yy, n)
    elif method == "omp":
        w = omp(G, c, kw.get("n_nonzero_coefs"))
    elif method in ("lars", "lasso_lars"):
        path = lars_path(G, c, n, lasso=(method == "lasso_lars"),
                         max_steps=kw.get("n_nonzero_coefs", 500) if method == "lars" else None,
                         alpha_min=kw.get("alpha", 1.0) if method == "lasso_lars" else 0.0)
        w = path[-1][1]
    else:
        raise ValueError(f"unknown linear method {method!r}")
    coef = w * sy / sx
    intercept = float(mo.mean[p] - coef @ mo.mean[:p])
    return coef, intercept, info


def fit(df: DataFrame, features: Sequence[str], target: str, method: str = "ols",
        scale_x: bool = True, scale_y: bool = True, **kw) -> LinearModel:
    return fit_moments(moments(df, list(features) + [target])[None], features, target, method, scale_x, scale_y, **kw)


def fit_moments(mo: Moments, features: Sequence[str], target: str, method: str = "ols",
                scale_x: bool = True, scale_y: bool = True, **kw) -> LinearModel:
    coef, b, info = solve(mo, len(features), method, scale_x, scale_y, **kw)
    return LinearModel(list(features), coef, b, target, info)


def cv_path_select(df: DataFrame, features: Sequence[str], target: str, fold_col: str,
                   method: str, alphas: Sequence[float], scale: bool = True, **kw):
    """Pick alpha by k-fold MSE from ONE groupBy(fold) pass.

    Held-out squared error of a linear predictor is a quadratic form of the
    fold's own moments, so no second pass over the data is needed.
    Returns (best_alpha, per-alpha mean MSE dict).
    """
    fm = moments(df, list(features) + [target], group=fold_col)
    return cv_select(fm, len(features), method, alphas, scale, scale, **kw)


def sum_moments(parts: dict) -> Moments:
    """All parts together."""
    total = None
    for mo in parts.values():
        total = mo if total is None else total.combine(mo)
    return total


def cv_select(fm: dict, p: int, method: str, alphas: Sequence[float], scale_x: bool = True, scale_y: bool = True, **kw):
    """The alpha of least mean held-out error, and every alpha's error, from the
    moments of the folds."""
    total = sum_moments(fm)
    scores = {}
    for a in alphas:
        errs = []
        for part in fm.values():
            coef, b, _ = solve(total.minus(part), p, method, scale_x, scale_y, alpha=a, **kw)
            errs.append(heldout_mse(part, coef, b, p))
        scores[a] = float(np.mean(errs))
    best = min(scores, key=lambda a: (scores[a], a))
    return best, scores


def lars_cv(fm: dict, features: Sequence[str], target: str, lasso: bool, scale_x: bool = True, scale_y: bool = True):
    """Cross-validated least-angle path: every fold's path is evaluated at the knots of
    all folds (coefficients are linear between a path's knots), and the path of all
    rows is taken at the alpha of least mean held-out error."""
    p, total = len(features), sum_moments(fm)

    def path_of(mo):
        G, c, _, sx, sy = _scaled_system(mo, p, scale_x, scale_y)
        knots = lars_path(G, c, mo.n, lasso=lasso, max_steps=None if lasso else p)
        alphas = np.array([a for a, _ in knots])[::-1]
        coefs = np.array([w for _, w in knots])[::-1] * sy / sx
        return alphas, coefs

    def at(path, alpha):
        alphas, coefs = path
        return np.array([np.interp(alpha, alphas, coefs[:, j]) for j in range(p)])

    paths = {g: path_of(total.minus(part)) for g, part in fm.items()}
    knots = sorted({float(a) for alphas, _ in paths.values() for a in alphas})
    scores = {}
    for alpha in knots:
        errs = []
        for g, part in fm.items():
            coef, train = at(paths[g], alpha), total.minus(part)
            errs.append(heldout_mse(part, coef, float(train.mean[p] - coef @ train.mean[:p]), p))
        scores[alpha] = float(np.mean(errs))
    best = min(scores, key=lambda a: (scores[a], a))
    coef = at(path_of(total), best)
    return best, scores, LinearModel(list(features), coef, float(total.mean[p] - coef @ total.mean[:p]), target, {})


def heldout_mse(part: Moments, coef: np.ndarray, b: float, p: int) -> float:
    """Mean of (y - b - x.w)^2 over a part, from its moments only."""
    v = np.concatenate([-coef, [1.0]])
    resid_mean = part.mean[p] - b - coef @ part.mean[:p]
    return float(v @ part.C @ v / part.n + resid_mean ** 2) if part.n else float("nan")


def default_alpha_grid(mo: Moments, p: int, l1_ratio: float = 1.0, n_alphas: int = 100,
                       eps: float = 1e-3, scale: bool = True) -> list[float]:
    G, c, yy, sx, sy = _scaled_system(mo, p, scale, scale)
    amax = np.max(np.abs(c)) / (mo.n * max(l1_ratio, 1e-3)) if p else 1.0
    return list(np.geomspace(amax, amax * eps, n_alphas))


def loo_ridge_scores(df: DataFrame, features: Sequence[str], target: str,
                     alphas: Sequence[float] = (0.1, 1.0, 10.0)) -> dict:
    """R3 (RidgeCV): leave-one-out MSE per alpha from the hat diagonal.

    One moments pass, then ONE more pass where each row computes
    e_i / (1 - h_i) for every alpha with broadcast p x p inverses.
    """
    p = len(features)
    mo = moments(df, list(features) + [target])[None]
    G, c, yy, sx, sy = _scaled_system(mo, p, True, True)
    aggs = []
    z = [(to_double(f) - F.lit(float(mo.mean[j]))) / F.lit(float(sx[j])) for j, f in enumerate(features)]
    ys = (to_double(target) - F.lit(float(mo.mean[p]))) / F.lit(float(sy))
    for k, a in enumerate(alphas):
        Ainv = np.linalg.inv(G + a * np.eye(p))
        w = Ainv @ c
        pred = F.lit(0.0)
        for j in range(p):
            pred = pred + F.lit(float(w[j])) * z[j]
        h = F.lit(1.0 / mo.n)  # centering adds 1/n to the hat diagonal
        for i in range(p):
            for j in range(p):
                if Ainv[i, j] != 0:
                    h = h + F.lit(float(Ainv[i, j])) * z[i] * z[j]
        e = (ys - pred) / (F.lit(1.0) - h)
        aggs.append(F.avg(e * e).alias(f"a{k}"))
    row = df.agg(*aggs).first()
    return {a: float(row[f"a{k}"]) * sy * sy for k, a in enumerate(alphas)}
