"""Report composition (S11-S16) and saved runs (S19): every sheet is a small DataFrame
with one row per entry; ``sinks.write_sheets`` puts them under a run directory."""

from __future__ import annotations

import json
from dataclasses import asdict
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions.exprs import to_double
from quarry.operators import metrics, profile, transform
from quarry.sources import sinks

NAME_WIDTH = 10  # characters of a column name on the first sheet


def _pairs(spark: SparkSession, rows: Sequence[tuple], key: str = "property") -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in rows], f"{key} string, value string")


def _common(run, file_name: str) -> dict[str, DataFrame]:
    """Sheets that regression and classification share."""
    spark, cfg, roles = run.predictions.sparkSession, run.config, run.roles
    size = {r["split"]: r["n"] for r in run.predictions.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    short = lambda names: [str(n)[:NAME_WIDTH] for n in names]
    shapes = [(f"{part}_{split} shape", (size.get(split, 0), len(cols)))
              for part, cols in (("X", run.features), ("y", roles.targets)) for split in ("train", "test")]
    out = {
        "preprocessing": _pairs(spark, [("filename", file_name), ("indicators", short(roles.indicators)),
                                        ("predictors", short(roles.targets)), ("stratify variable", roles.stratify),
                                        ("scaling", cfg.scaler), ("seed", cfg.seed), *shapes]),
        "model_selection": _pairs(spark, [("model", cfg.model), *sorted(cfg.params.items())], "parameter"),
    }
    if "selection" in run.info:
        table = run.info["selection"].collect()  # a row per feature
        kept = [r["feature"] for r in table if r["selected"]]
        out["feature_selection"] = _pairs(spark, [
            ("method", cfg.select_method), ("k requested", cfg.select_k), ("original features", len(table)),
            ("selected features", len(kept)), ("selected feature names", ", ".join(kept))])
    if "outliers" in run.info:
        o = run.info["outliers"].first()
        out["outlier_handling"] = _pairs(spark, [
            ("method", o["method"]), ("action", o["action"]), ("outliers detected", o["outliers"]),
            ("original samples", o["original"]), ("remaining samples", o["remaining"])])
        if "outliers_removed" in run.info:
            out["outlier_samples_removed"] = run.info["outliers_removed"]
    return out


def cross_validation_sheets(folds: DataFrame, kind: str, k: int) -> dict[str, DataFrame]:
    """Summary (a row per metric), fold scores, settings."""
    names = [c for c in folds.columns if c != "fold"]
    wide = folds.agg(*[x for c in names for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std")) for c in names])
    return {"summary": wide.select(F.explode(rows).alias("r")).select("r.*"), "fold_scores": folds,
            "settings": folds.sparkSession.createDataFrame([(kind, int(k))], "cv_type string, folds int")}


def regression_sheets(run, units: str = "", file_name: str = "", bins: dict[str, str] | None = None,
                      cv: DataFrame | None = None) -> dict[str, DataFrame]:
    """Sheets of a regression run. ``bins``: target -> column of strata for the
    quantile sheet; ``cv``: the summary sheet of ``cross_validation_sheets``."""
    values = ["r2", "rmse", "mae", "explained_variance", "median_ae", "max_error", "mape"]
    spark = run.predictions.sparkSession
    over = {r["split"]: r for r in run.metrics.groupBy("split").agg(*[F.avg(c).alias(c) for c in values]).collect()}
    rows = [(c, *(float(over[s][c]) if s in over and over[s][c] is not None else None for s in ("train", "test"))) for c in values]
    out = _common(run, file_name)
    out["overall_performance"] = spark.createDataFrame(rows, "metric string, train double, test double").withColumn("units", F.lit(units))
    for split in ("train", "test"):
        out[f"{split}_results"] = run.metrics.where(F.col("split") == split).drop("split").select("target", "n", *values)
    if bins:
        test = run.predictions.where(F.col("split") == "test")
        parts = [metrics.metrics_by_bin(test, t, f"Predicted_{t}", b).withColumnRenamed(b, "bin")
                 .withColumn("bin", F.col("bin").cast("string")).withColumn("target", F.lit(t)) for t, b in bins.items()]
        table = parts[0]
        for p in parts[1:]:
            table = table.unionByName(p)
        out["quantile_bin_results"] = table
    if cv is not None:
        out["cross_validation"] = cv
    return out


def classification_sheets(run, classes: Sequence[str], units: str = "", file_name: str = "") -> dict[str, DataFrame]:
    """Sheets of a classification run, over its test rows. Per-class AUC and
    average precision need the model's ``prob_<class>`` columns."""
    target = run.roles.targets[0]
    pred, test = f"Predicted_{target}", run.predictions.where(F.col("split") == "test")
    out = _common(run, file_name)
    summary = metrics.classification_summary(test, target, pred, classes)
    names = summary.columns
    out["overall_performance"] = summary.withColumn("units", F.lit(units))
    out["classification_report"] = metrics.classification_report(test, target, pred, classes)
    out["confusion_matrix"] = metrics.confusion_counts(test, target, pred, classes)
    out["additional_metrics"] = summary.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), to_double(c).alias("value")) for c in names])).alias("r")).select("r.*")
    out["per_class_metrics"] = metrics.per_class_stats(test, target, pred, classes)
    if all(f"prob_{c}" in test.columns for c in classes):
        ranks = metrics.rank_metrics(metrics.stack_scores(test, target, {c: f"prob_{c}" for c in classes}))
        out["per_class_roc_auc"] = ranks.select("class", "roc_auc")
        out["per_class_average_precision"] = ranks.select("class", "average_precision")
    return out


def cluster_sheets(run) -> dict[str, DataFrame]:
    """Scores, chosen k, sizes, centers where the method has them, and the scan."""
    spark = run.scores.sparkSession
    out = {"scores": run.scores, "sizes": run.sizes, "best_k": spark.createDataFrame([(int(run.k),)], "k int")}
    if getattr(run.model, "centers", None) is not None:
        rows = [(i, f, float(v)) for i, c in enumerate(run.model.centers) for f, v in zip(run.model.features, c)]
        out["centers"] = spark.createDataFrame(rows, "cluster int, feature string, value double")
    if run.scan is not None:
        out["silhouette_grid"] = run.scan
    return out


def target_summary(run, path: str | None = None) -> DataFrame:
    """What the training targets looked like; numbers are described, classes
    counted. Written as one JSON document where a path is given."""
    train, task = run.predictions.where(F.col("split") == "train"), None
    numeric = [t for t in run.roles.targets if train.schema[t].dataType.typeName() not in ("string", "boolean")]
    if numeric:
        task, table = "regression", profile.describe(train, numeric)
    else:
        task, table = "classification", profile.value_counts(train, run.roles.targets[0])
    if path:
        sinks.write_json_doc(train.sparkSession, {"model_type": task, "summary": [r.asDict() for r in table.collect()]}, path)
    return table


def save_run(run, path: str) -> str:
    """Models, scalers, one-hot levels, feature order and configuration."""
    spark = run.predictions.sparkSession
    for i, target in enumerate(run.roles.targets):
        sinks.save_model(spark, run.fitted[target], f"{path}/model_{i}")

    def scaler(s):
        if isinstance(s, transform.ScalerModel):
            return {"type": "scaler", "kind": s.kind, "center": s.center, "scale": s.scale}
        return {"type": "quantile", "landmarks": {c: list(map(float, v)) for c, v in s.landmarks.items()}, "n_quantiles": s.n_quantiles}

    doc = {"config": asdict(run.config), "roles": asdict(run.roles), "features": run.features,
           "onehot": run.onehot.levels if run.onehot else None, "x_scaler": scaler(run.x_scaler),
           "y_scalers": {t: scaler(s) for t, s in run.y_scalers.items()}}
    return sinks.write_json_doc(spark, json.loads(json.dumps(doc, default=str)), f"{path}/run")


def load_run(spark: SparkSession, path: str):
    """A run that ``workflow.score`` takes; it has no predictions or metrics."""
    from quarry.plans.workflow import ModelRun, Roles, TrainConfig
    doc = sinks.read_json_doc(spark, f"{path}/run")

    def scaler(d):
        if d["type"] == "scaler":
            return transform.ScalerModel(d["kind"], d["center"], d["scale"])
        return transform.QuantileModel(d["landmarks"], d["n_quantiles"])

    roles = Roles(**doc["roles"])
    fitted = {t: sinks.load_model(spark, f"{path}/model_{i}") for i, t in enumerate(roles.targets)}
    onehot = transform.OneHotModel(doc["onehot"]) if doc["onehot"] else None
    return ModelRun(TrainConfig(**doc["config"]), roles, doc["features"], fitted, onehot, scaler(doc["x_scaler"]),
                    {t: scaler(s) for t, s in doc["y_scalers"].items()}, None, None)
