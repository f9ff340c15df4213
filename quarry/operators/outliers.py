"""Outlier detection and handling, fitted on the train split only.

IQR / z-score bounds come from one aggregation pass and are applied as a
single boolean expression. Isolation forest and LOF live in
``quarry.operators.isolation`` and ``quarry.operators.neighbors``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.exprs import all_true, col, to_double
from quarry.functions.quantiles import column_quantiles
from quarry.session import cut_lineage
from quarry.operators.transform import ClipModel


def iqr_bounds(df: DataFrame, cols: Sequence[str]) -> ClipModel:
    qs = column_quantiles(df, list(cols), [0.25, 0.75])
    lo, hi = {}, {}
    for c in cols:
        q1, q3 = qs[c]
        iqr = q3 - q1
        lo[c], hi[c] = q1 - 1.5 * iqr, q3 + 1.5 * iqr
    return ClipModel(lo, hi)


def zscore_bounds(df: DataFrame, cols: Sequence[str]) -> tuple[dict, dict]:
    row = df.agg(*[x for i, c in enumerate(cols) for x in
                   (F.avg(to_double(c)).alias(f"m{i}"), F.stddev_samp(to_double(c)).alias(f"s{i}"))]).first()
    return ({c: row[f"m{i}"] for i, c in enumerate(cols)}, {c: row[f"s{i}"] for i, c in enumerate(cols)})


def inlier_expr(method: str, bounds, cols: Sequence[str]) -> Column:
    """O1: every feature inside [Q1-1.5IQR, Q3+1.5IQR]; O2: every |z| < 3
    (sample sd; a constant column never makes a row an outlier)."""
    if method == "IQR":
        return all_true([(to_double(c) >= F.lit(float(bounds.lower[c])))
                         & (to_double(c) <= F.lit(float(bounds.upper[c]))) for c in cols])
    if method == "ZScore":
        mean, sd = bounds
        conds = []
        for c in cols:
            if not sd[c]:
                continue
            conds.append(F.abs((to_double(c) - F.lit(float(mean[c]))) / F.lit(float(sd[c]))) < 3)
        return all_true(conds)
    raise ValueError(method)


def detect(train: DataFrame, cols: Sequence[str], method: str = "IQR", key_cols: Sequence[str] | None = None,
           **kw) -> Column:
    """Fit on train, return the inlier boolean expression (IQR, ZScore,
    IsolationForest; LocalOutlierFactor needs a join, see ``handle``)."""
    if method == "IQR":
        return inlier_expr("IQR", iqr_bounds(train, cols), cols)
    if method == "ZScore":
        return inlier_expr("ZScore", zscore_bounds(train, cols), cols)
    if method == "IsolationForest":
        from quarry.operators.isolation import fit_isolation_forest
        m = fit_isolation_forest(train, cols, list(key_cols or cols), **kw)
        return (-m.score_expr()) >= F.lit(m.offset)
    raise ValueError(f"unknown method {method!r}")


def cap_model(train: DataFrame, cols: Sequence[str], method: str = "IQR") -> ClipModel:
    """IQR bounds, mean +- 3 sd, or otherwise the 1 % / 99 % quantiles."""
    if method == "IQR":
        return iqr_bounds(train, cols)
    if method == "ZScore":
        m, s = zscore_bounds(train, cols)
        return ClipModel({c: m[c] - 3 * (s[c] or 0.0) for c in cols}, {c: m[c] + 3 * (s[c] or 0.0) for c in cols})
    qs = column_quantiles(train, list(cols), [0.01, 0.99])
    return ClipModel({c: qs[c][0] for c in cols}, {c: qs[c][1] for c in cols})


def handle(df: DataFrame, cols: Sequence[str], split_col: str = "split", method: str = "IQR",
           action: str = "remove", inlier: Column | None = None,
           key_cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """O5/O6/O7 on a frame holding both splits.

    remove: drop train outliers, test untouched. cap: clip both splits to
    train bounds. Returns (processed frame, one-row info frame).
    """
    train = df.where(col(split_col) == "train")
    if method in (None, "none"):
        flag = F.lit(True)
    elif inlier is not None:
        flag = inlier
    elif method == "LocalOutlierFactor":
        from quarry.operators.neighbors import local_outlier_factor
        # numbered rows, fixed by a checkpoint: equal rows stay apart
        ided = cut_lineage(df.withColumn("__oid", F.monotonically_increasing_id()))
        lof = local_outlier_factor(ided.where(col(split_col) == "train"), "__oid", cols, 20, 0.1)
        df = ided.join(lof.select("__oid", F.col("inlier").alias("__lof_in")), "__oid", "left").drop("__oid")
        train = df.where(col(split_col) == "train")
        flag = F.coalesce(F.col("__lof_in"), F.lit(True))
    else:
        flag = detect(train, cols, method, key_cols)
    marked = df.withColumn("__inlier", F.when(col(split_col) == "train", flag).otherwise(F.lit(True)))
    if "__lof_in" in marked.columns:
        marked = marked.drop("__lof_in")
    info = (marked.where(col(split_col) == "train")
            .agg(F.count_if(~F.col("__inlier")).alias("outliers"), F.count(F.lit(1)).alias("original"))
            .select(F.lit(method).alias("method"), F.lit(action).alias("action"), "outliers", "original",
                    (F.col("original") - F.col("outliers")).alias("remaining")))
    if action == "remove":
        out = marked.where(F.col("__inlier")).drop("__inlier")
    elif action == "cap":
        out = cap_model(train, cols, method).transform(marked.drop("__inlier"))
    else:
        raise ValueError(f"unknown action {action!r}")
    return out, info
