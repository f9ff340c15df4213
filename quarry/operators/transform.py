"""Feature transforms (F1-F11): fit = one aggregation pass, apply = column
expressions (whole-stage codegen), so fitted on the train split and applied
to train, test and new data alike. Models serialise to JSON for scoring.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.exprs import col, to_double
from quarry.functions.quantiles import column_quantiles


@dataclass
class ScalerModel:
    """x -> (x - center) / scale per column; ``inverse`` undoes it."""
    kind: str
    center: dict
    scale: dict

    def expr(self, c: str) -> Column:
        return (to_double(c) - F.lit(float(self.center[c]))) / F.lit(float(self.scale[c]))

    def inverse_expr(self, c: str, value: Column | None = None) -> Column:
        v = to_double(c) if value is None else value
        return v * F.lit(float(self.scale[c])) + F.lit(float(self.center[c]))

    def transform(self, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
        cols = set(cols or self.center)
        return df.select(*[(self.expr(f).alias(f) if f in cols else col(f)) for f in df.columns])

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "center": self.center, "scale": self.scale})


def _nz(v: float | None) -> float:
    return 1.0 if (v is None or v == 0 or not np.isfinite(v)) else float(v)


def fit_standard(df: DataFrame, cols: Sequence[str]) -> ScalerModel:
    """mean and population sd (sd 0 -> 1)."""
    row = df.agg(*[x for i, c in enumerate(cols) for x in
                   (F.avg(to_double(c)).alias(f"m{i}"), F.stddev_pop(to_double(c)).alias(f"s{i}"))]).first()
    return ScalerModel("standard", {c: row[f"m{i}"] for i, c in enumerate(cols)},
                       {c: _nz(row[f"s{i}"]) for i, c in enumerate(cols)})


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> ScalerModel:
    """(x - min) / (max - min) (range 0 -> 1)."""
    row = df.agg(*[x for i, c in enumerate(cols) for x in
                   (F.min(to_double(c)).alias(f"a{i}"), F.max(to_double(c)).alias(f"b{i}"))]).first()
    return ScalerModel("minmax", {c: row[f"a{i}"] for i, c in enumerate(cols)},
                       {c: _nz(row[f"b{i}"] - row[f"a{i}"]) for i, c in enumerate(cols)})


def fit_robust(df: DataFrame, cols: Sequence[str]) -> ScalerModel:
    """median and IQR (IQR 0 -> 1)."""
    qs = column_quantiles(df, list(cols), [0.25, 0.5, 0.75])
    return ScalerModel("robust", {c: qs[c][1] for c in cols},
                       {c: _nz(qs[c][2] - qs[c][0]) for c in cols})


def fit_identity(df: DataFrame, cols: Sequence[str]) -> ScalerModel:
    return ScalerModel("none", {c: 0.0 for c in cols}, {c: 1.0 for c in cols})


@dataclass
class QuantileModel:
    """uniform output via 1000 landmarks, interpolated; ties average the
    forward and backward interpolation (as the usual quantile transformer)."""
    landmarks: dict
    n_quantiles: int

    def transform(self, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
        cols = list(cols or self.landmarks)
        refs = np.linspace(0, 1, self.n_quantiles)
        lm = {c: np.asarray(self.landmarks[c], float) for c in cols}

        def make(c):
            q = lm[c]

            @F.pandas_udf("double")
            def f(s: pd.Series) -> pd.Series:
                x = s.to_numpy(float)
                fwd = np.interp(x, q, refs)
                bwd = -np.interp(-x, -q[::-1], -refs[::-1])
                out = 0.5 * (fwd + bwd)
                out[x <= q[0]] = 0.0
                out[x >= q[-1]] = 1.0
                out[np.isnan(x)] = np.nan
                return pd.Series(out)
            return f

        return df.select(*[(make(c)(to_double(c)).alias(c) if c in cols else col(c)) for c in df.columns])


def fit_quantile(df: DataFrame, cols: Sequence[str], n_quantiles: int = 1000) -> QuantileModel:
    probs = list(np.linspace(0, 1, n_quantiles))
    qs = column_quantiles(df, list(cols), probs)
    return QuantileModel({c: list(np.maximum.accumulate(np.asarray(qs[c], float))) for c in cols}, n_quantiles)


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "standard"):
    """Fit the scaler of that name; an unknown name raises."""
    try:
        fit = SCALERS[str(kind or "none").lower().removesuffix("scaler").removesuffix("transformer")]
    except KeyError:
        raise ValueError(f"unknown scaler {kind!r}; known: {', '.join(SCALERS)}") from None
    return fit(df, cols)


AFFINE = ("none", "standard", "minmax", "robust")
SCALERS = {"none": fit_identity, "standard": fit_standard, "minmax": fit_minmax,
           "robust": fit_robust, "quantile": fit_quantile}


@dataclass
class OneHotModel:
    """one 0/1 column per level seen in training; unseen -> all zeros.
    Levels are bounded by the categorical rule (<= 50 distinct)."""
    levels: dict = field(default_factory=dict)

    def names(self, c: str) -> list[str]:
        return [f"{c}_{v}" for v in self.levels[c]]

    def exprs(self, c: str) -> list[Column]:
        s = col(c).cast("string")
        return [F.when(s == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{v}")
                for v in self.levels[c]]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        rest = [col(c) for c in df.columns if c not in self.levels]
        return df.select(*rest, *[e for c in self.levels for e in self.exprs(c)])


def fit_onehot(df: DataFrame, cols: Sequence[str], max_levels: int | None = None) -> OneHotModel:
    """Levels seen in training, sorted: one per output column. With ``max_levels`` a
    column of more levels raises, after reading no more than that many."""
    levels = {}
    for c in cols:
        found = df.select(col(c).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct()
        vals = [r[0] for r in (found if max_levels is None else found.limit(max_levels + 1)).collect()]
        if max_levels is not None and len(vals) > max_levels:
            raise ValueError(f"{c}: more than {max_levels} levels; not categorical")
        levels[c] = sorted(vals)
    return OneHotModel(levels)


def feature_names(numeric: Sequence[str], onehot: OneHotModel | None) -> list[str]:
    """F2 order: numeric passthrough first, then one-hot columns."""
    out = list(numeric)
    if onehot:
        for c in onehot.levels:
            out += onehot.names(c)
    return out


@dataclass
class ClipModel:
    """Clip each column to [lower, upper] learned on train."""
    lower: dict
    upper: dict

    def expr(self, c: str) -> Column:
        x = to_double(c)
        return F.least(F.greatest(x, F.lit(float(self.lower[c]))), F.lit(float(self.upper[c])))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[(self.expr(c).alias(c) if c in self.lower else col(c)) for c in df.columns])


def fit_winsorizer(df: DataFrame, cols: Sequence[str], lower: float = 0.01, upper: float = 0.99) -> ClipModel:
    qs = column_quantiles(df, list(cols), [lower, upper])
    return ClipModel({c: qs[c][0] for c in cols}, {c: qs[c][1] for c in cols})


@dataclass
class ImputerModel:
    """fill NULLs with a statistic learned on train."""
    fills: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[(F.coalesce(to_double(c), F.lit(float(self.fills[c]))).alias(c)
                            if c in self.fills and self.fills[c] is not None else col(c)) for c in df.columns])


def fit_imputer(df: DataFrame, cols: Sequence[str], strategy: str = "median") -> ImputerModel:
    if strategy == "mean":
        row = df.agg(*[F.avg(to_double(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        return ImputerModel({c: row[f"m{i}"] for i, c in enumerate(cols)})
    qs = column_quantiles(df, list(cols), [0.5])
    return ImputerModel({c: qs[c][0] for c in cols})
