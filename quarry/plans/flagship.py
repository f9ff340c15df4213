"""Minimum end-to-end slice: clean -> profile -> split -> scale -> OLS ->
score -> metrics per split (S1, P1, P11, A1, A5, B9, F3, F7, R1, E1, I1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import clean, linear, metrics, split
from quarry.plans.common import LI_FEATS, LI_KEYS, LI_TARGET, SEED, t


def fit_ols_split(spark: SparkSession, sf: str, method: str = "ols", **kw):
    li = t(spark, sf, "lineitem")
    frame = clean.model_frame(li, LI_FEATS, [LI_TARGET], keep=LI_KEYS)
    frame = clean.preprocess(frame, [LI_TARGET], LI_FEATS, "all", None, drop_zero=None)
    sp = split.train_test_split(frame, LI_KEYS, 0.2, SEED)
    model = linear.fit(sp.where(F.col("split") == "train"), LI_FEATS, LI_TARGET, method,
                       scale_x=True, scale_y=True, **kw)
    return sp, model


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    sp, model = fit_ols_split(spark, sf)
    scored = model.transform(sp)
    return metrics.regression_metrics(scored, LI_TARGET, "prediction", group=["split"])
