"""Train / score workflow (sections 3.1-3.2; I1, I2, I4, F7, F8, O5-O7, K1-K4, T12).

``train`` keeps the reference's stage order: clean -> modelling frame ->
strata -> seeded split -> one-hot (fit on train) -> scale X and, for
regression, y (fit on train) -> outliers (train only) -> feature selection
(train only) -> fit -> predict both splits -> inverse-scale -> metrics.
Everything is lazy DataFrame work up to each fit; only statistics and
metric rows reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from quarry.functions.exprs import col, key_hash, numeric_columns, to_double
from quarry.operators import clean, metrics, outliers, select, split, transform
from quarry.plans import models
from quarry.session import cut_lineage


@dataclass
class Roles:
    indicators: list
    targets: list
    key: list  # unique row key (integer/string columns)
    categoricals: list = field(default_factory=list)
    stratify: str | None = None


@dataclass
class TrainConfig:
    model: str = "Linear"
    scaler: str = "standard"
    test_size: float = 0.2
    seed: int = 42
    stratify: bool = False
    drop_missing: str = "all"
    impute: object = None
    drop_zero: str | None = None
    zero_values: list = field(default_factory=list)
    outlier_method: str = "none"
    outlier_action: str = "remove"
    select_method: str | None = None  # 'SelectKBest' | 'RFE' | 'SelectFromModel'
    select_k: int | None = None
    n_clusters: int = 3
    params: dict = field(default_factory=dict)  # hyper-parameters of the model


@dataclass
class ModelRun:
    config: TrainConfig
    roles: Roles
    features: list
    fitted: dict  # target -> fitted model
    onehot: object
    x_scaler: object
    y_scalers: dict
    predictions: DataFrame
    metrics: DataFrame
    info: dict = field(default_factory=dict)


def _prepare(df: DataFrame, roles: Roles, cfg: TrainConfig):
    frame = clean.preprocess(df.select(*dict.fromkeys(roles.key + roles.indicators + roles.targets
                                                       + roles.categoricals
                                                       + ([roles.stratify] if roles.stratify else []))),
                             roles.targets, roles.indicators, cfg.drop_missing, cfg.impute, cfg.drop_zero,
                             cfg.zero_values)
    frame = clean.model_frame(frame, roles.indicators, roles.targets, roles.categoricals,
                              keep=roles.key + ([roles.stratify] if roles.stratify else []))
    return frame


def split_frame(df: DataFrame, roles: Roles, cfg: TrainConfig) -> DataFrame:
    """The cleaned modelling frame with its split; outliers and selection play no part in it."""
    task = models.problem_type(cfg.model)
    frame = _prepare(df, roles, cfg)
    strat = None
    if cfg.stratify:
        scol = roles.stratify or roles.targets[0]
        if scol in roles.targets and roles.stratify:
            raise ValueError("the stratify column must not be a target")
        if task == "classification":
            got, _ = split.class_strata(frame, scol, cfg.test_size)
        else:
            got, _, _ = split.quantile_strata(frame, scol, 5, 2, cfg.test_size)
        if got is not None:
            frame, strat = got, "__stratum"
    return split.train_test_split(frame, roles.key, cfg.test_size, cfg.seed, stratify=strat)


def train(df: DataFrame, roles: Roles, cfg: TrainConfig, sp: DataFrame | None = None) -> ModelRun:
    """``sp``: the result of ``split_frame``, where several runs share it."""
    task = models.problem_type(cfg.model)
    sp = split_frame(df, roles, cfg) if sp is None else sp
    train_df = sp.where(F.col("split") == "train")
    num = numeric_columns(sp, roles.indicators)
    oh = transform.fit_onehot(train_df, roles.categoricals) if roles.categoricals else None
    if oh:
        sp = oh.transform(sp)
    feats = transform.feature_names(num, oh)
    scaler_kind = cfg.scaler
    if cfg.model in ("MultinomialNB_classifier", "ComplementNB_classifier", "CategoricalNB_classifier"):
        scaler_kind = "minmax"
    xs = transform.fit_scaler(sp.where(F.col("split") == "train"), feats, scaler_kind)
    sp = xs.transform(sp, feats)
    ys = {}
    if task == "regression" and isinstance(xs, transform.ScalerModel):
        for tgt in roles.targets:
            ys[tgt] = transform.fit_scaler(sp.where(F.col("split") == "train"), [tgt], cfg.scaler)
            if isinstance(ys[tgt], transform.ScalerModel):
                sp = ys[tgt].transform(sp, [tgt])
    info = {}
    if cfg.outlier_method and cfg.outlier_method != "none":
        before = sp
        sp, info["outliers"] = outliers.handle(sp, feats, "split", cfg.outlier_method, cfg.outlier_action, key_cols=roles.key)
        if cfg.outlier_action == "remove":  # O7: the keys of the rows that went
            info["outliers_removed"] = before.select(*roles.key).join(sp.select(*roles.key), roles.key, "left_anti")
    if cfg.select_method and (cfg.select_k or cfg.select_method == "SelectFromModel"):
        tr = sp.where(F.col("split") == "train")
        first = roles.targets[0]  # selection on the first target only
        k = cfg.select_k or len(feats)
        if k <= 0:
            raise ValueError("k must be positive")
        if k < len(feats) or cfg.select_method == "SelectFromModel":
            if cfg.select_method == "SelectKBest":
                table = (select.f_classif(tr, feats, first, k) if task == "classification"
                         else select.f_regression(tr, feats, first, k))
            elif cfg.select_method == "RFE":
                table = select.rfe(tr, feats, first, k, task)
            else:
                table = select.select_from_model(tr, feats, first, task)
            keep = [r["feature"] for r in table.where("selected").collect()]
            info["selection"] = table
            feats = [f for f in feats if f in keep]
    fitted, preds = {}, sp
    for tgt in roles.targets:
        m = models.make(cfg.model, cfg.params, prescaled=True).fit(preds.where(F.col("split") == "train"), feats, tgt)
        fitted[tgt] = m
        preds = m.transform(preds).withColumnRenamed("prediction", f"Predicted_{tgt}")
        if tgt in ys and isinstance(ys[tgt], transform.ScalerModel):  # F8: back to original units
            preds = (preds.withColumn(f"Predicted_{tgt}", ys[tgt].inverse_expr(tgt, F.col(f"Predicted_{tgt}")))
                     .withColumn(tgt, ys[tgt].inverse_expr(tgt)))
    preds = preds.persist()
    mets = []
    for tgt in roles.targets:
        if task == "regression":
            m = metrics.regression_metrics(preds, tgt, f"Predicted_{tgt}", group=["split"])
        else:
            from quarry.operators.native import class_list
            classes = class_list(preds, tgt)  # bounded distinct labels, bin-aware order
            m = metrics.classification_summary(preds.where(F.col("split") == "test"), tgt,
                                               f"Predicted_{tgt}", classes).withColumn("split", F.lit("test"))
        mets.append(m.withColumn("target", F.lit(tgt)))
    allm = mets[0]
    for m in mets[1:]:
        allm = allm.unionByName(m)
    return ModelRun(cfg, roles, feats, fitted, oh, xs, ys, preds, allm, info)


def score(run: ModelRun, df: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Replay cleaning (target scopes fall back to indicator), require
    features, one-hot, scale, predict, decode/inverse-scale, name outputs."""
    roles, cfg = run.roles, run.config
    scope = "indicator" if cfg.drop_missing in ("target", "indicatorAndTarget") else cfg.drop_missing
    missing = [c for c in roles.indicators + roles.categoricals if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    out = clean.preprocess(df, [], roles.indicators, scope, cfg.impute, None)
    if run.onehot:
        out = run.onehot.transform(out)
    out = run.x_scaler.transform(out, [f for f in run.features if f in out.columns]) if hasattr(
        run.x_scaler, "center") else run.x_scaler.transform(out, run.features)
    many = len(roles.targets) > 1
    for i, tgt in enumerate(roles.targets):
        name = f"Predicted_{tgt}" if many else "Predicted_Target"
        out = run.fitted[tgt].transform(out).withColumnRenamed("prediction", name)
        if tgt in run.y_scalers and isinstance(run.y_scalers[tgt], transform.ScalerModel):
            out = out.withColumn(name, run.y_scalers[tgt].inverse_expr(tgt, F.col(name)))
    return out


def prediction_summary(scored: DataFrame, pred_col: str) -> DataFrame:
    """I4: numeric summary (A13) or value counts (A10) of a prediction column."""
    from quarry.operators import profile
    if scored.schema[pred_col].dataType.typeName() in ("double", "float", "integer", "long"):
        return profile.describe(scored, [pred_col])
    return profile.value_counts(scored, pred_col)


def baseline_vs_advanced(df: DataFrame, roles: Roles, cfg: TrainConfig) -> DataFrame:
    """When outliers or selection are on, also fit without them; metrics tagged.
    Both runs read one cached split; each run's caches end with it."""
    if (cfg.outlier_method in (None, "none")) and not cfg.select_method:
        return train(df, roles, cfg).metrics.withColumn("run", F.lit("advanced"))
    sp = split_frame(df, roles, cfg).persist(StorageLevel.MEMORY_AND_DISK)
    out = []
    try:
        for name, one in (("baseline", replace(cfg, outlier_method="none", select_method=None)), ("advanced", cfg)):
            run = train(df, roles, one, sp)
            out.append(cut_lineage(run.metrics.withColumn("run", F.lit(name))))
            run.predictions.unpersist()
    finally:
        sp.unpersist()
    return out[0].unionByName(out[1])


def add_row_key(df: DataFrame, cols: Sequence[str], name: str = "__rid") -> DataFrame:
    """Deterministic 64-bit row id from natural key columns."""
    return df.withColumn(name, F.xxhash64(*[col(c) for c in cols]))


@dataclass
class ClusterRun:
    model: object
    k: int
    scan: DataFrame | None
    labels: DataFrame
    scores: DataFrame
    sizes: DataFrame


def train_cluster(df: DataFrame, features: Sequence[str], key: Sequence[str], model: str = "kmeans",
                  k: int = 3, scan: Sequence[int] | None = range(2, 9), refit_best_k: bool = True,
                  scaler: str = "standard", test_size: float = 0.2, seed: int = 42) -> ClusterRun:
    """Clustering lifecycle: seeded split, scaler fitted on train, optional
    k scan by silhouette (U10), fit with the chosen k, labels for both splits
    where the method can assign new points (U11), then CH / DB / squared
    silhouette and cluster sizes on the test split (NULL scores with < 2
    clusters)."""
    from quarry.operators import metrics as M
    from quarry.operators.cluster import ClusterModel, scan_k
    feats = list(features)
    sp = split.train_test_split(df.select(*dict.fromkeys(list(key) + feats)).na.drop(), list(key), test_size, seed)
    sc = transform.fit_scaler(sp.where(F.col("split") == "train"), feats, scaler)
    sp = sc.transform(sp, feats)
    train_df = sp.where(F.col("split") == "train")
    table = None
    chosen = k
    if scan and model in ("kmeans", "bisecting_kmeans"):
        table = scan_k(train_df, feats, scan, model, seed)
        best = table.orderBy(F.desc_nulls_last("silhouette_sq"), "k").first()
        if refit_best_k and best is not None:
            chosen = int(best["k"])
    fitted = models.make(model)(train_df, feats, chosen, id_col=key[0] if len(key) == 1 else None, seed=seed)
    if isinstance(fitted, ClusterModel):
        labels = fitted.transform(sp, "cluster")
    elif hasattr(fitted, "transform"):  # Spark ML mixture model
        from pyspark.ml.feature import VectorAssembler
        vec = VectorAssembler(inputCols=feats, outputCol="__x", handleInvalid="keep").transform(sp)
        labels = fitted.setFeaturesCol("__x").transform(vec).drop("__x", "probability")
    else:  # density / graph methods label the rows they were fitted on
        labels = sp.join(fitted, key[0], "inner") if len(key) == 1 else fitted
    test = labels.where(F.col("split") == "test")
    scores = M.cluster_scores(test, feats, "cluster", noise_label=-1)
    sil = M.silhouette_squared(test.where(F.col("cluster") != -1), feats, "cluster")
    sizes = profile_sizes(labels)
    s_val = sil.first()[0]
    return ClusterRun(fitted, chosen, table, labels, scores.withColumn("silhouette_sq", F.lit(s_val).cast("double")),
                      sizes)


def profile_sizes(labels: DataFrame) -> DataFrame:
    """Cluster sizes per split."""
    return labels.groupBy("split", "cluster").agg(F.count(F.lit(1)).alias("size"))
