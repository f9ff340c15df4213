import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.plans import reports, tune, workflow
from quarry.sources import sinks


@pytest.fixture(scope="module")
def flowers(spark):
    """Three classes with spaces in the column names."""
    rng = np.random.default_rng(0)
    rows = []
    for k, name in enumerate(("setosa", "versicolor", "virginica")):
        for i in range(50):
            a, b, c, d = rng.normal([5 + k, 3 - 0.2 * k, 1.5 + 2 * k, 0.3 + 0.8 * k], 0.3)
            rows.append((k * 50 + i, float(a), float(b), float(c), float(d), name))
    return spark.createDataFrame(rows, "id long, `sepal length` double, `sepal width` double, `petal length` double, "
                                       "`petal width` double, species string").persist()


X = ["sepal length", "sepal width", "petal length"]


def test_regression_report_and_saved_run(spark, flowers, tmp_path):
    roles = workflow.Roles(X, ["petal width"], ["id"], ["species"])
    cfg = workflow.TrainConfig("Ridge", params={"alpha": 2.0}, outlier_method="IQR", select_method="SelectKBest", select_k=2)
    run = workflow.train(flowers, roles, cfg)
    folds, _ = tune.cross_validate(flowers, X, "petal width", "Ridge", ["id"], 3)
    cv = reports.cross_validation_sheets(folds, "KFold", 3)
    assert {r.metric for r in cv["summary"].collect()} == {"r2", "rmse", "mae"} and cv["settings"].first()["folds"] == 3
    sheets = reports.regression_sheets(run, "cm", "flowers.csv", cv=cv["summary"])
    paths = sinks.write_sheets(sheets, str(tmp_path / "report"))
    back = {k: spark.read.parquet(p) for k, p in paths.items()}
    pre = {r["property"]: r["value"] for r in back["preprocessing"].collect()}
    assert pre["scaling"] == "standard" and "sepal leng" in pre["indicators"]
    assert ("alpha", "2.0") in [tuple(r) for r in back["model_selection"].collect()]
    overall = {r.metric: r for r in back["overall_performance"].collect()}
    assert 0.6 < overall["r2"].test <= 1 and overall["rmse"].units == "cm"
    kept = {r["property"]: r["value"] for r in back["feature_selection"].collect()}
    assert kept["selected features"] == "2"
    out = {r["property"]: int(r["value"]) for r in back["outlier_handling"].collect() if r["value"].isdigit()}
    assert back["outlier_samples_removed"].count() == out["outliers detected"] == out["original samples"] - out["remaining samples"]
    got = reports.target_summary(run, str(tmp_path / "target"))
    doc = sinks.read_json_doc(spark, str(tmp_path / "target"))
    assert doc["model_type"] == "regression" and doc["summary"][0]["n"] == got.first()["n"]

    reports.save_run(run, str(tmp_path / "run"))
    again = reports.load_run(spark, str(tmp_path / "run"))
    a = {r.id: r.Predicted_Target for r in workflow.score(run, flowers).collect()}
    b = {r.id: r.Predicted_Target for r in workflow.score(again, flowers).collect()}
    assert len(a) == 150 and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_classification_and_cluster_reports(spark, flowers, tmp_path):
    roles = workflow.Roles([*X, "petal width"], ["species"], ["id"])
    run = workflow.train(flowers, roles, workflow.TrainConfig("GaussianNB_classifier"))
    sheets = reports.classification_sheets(run, ["setosa", "versicolor", "virginica"])
    back = {k: spark.read.parquet(p) for k, p in sinks.write_sheets(sheets, str(tmp_path / "c")).items()}
    assert back["confusion_matrix"].count() == 9 and back["classification_report"].count() == 6
    assert back["per_class_roc_auc"].where("roc_auc > 0.9").count() == 3
    assert {r.metric: r.value for r in back["additional_metrics"].collect()}["accuracy"] > 0.9
    assert reports.target_summary(run).count() == 3
    c = workflow.train_cluster(flowers, [*X, "petal width"], ["id"], scan=range(2, 4))
    sheets = reports.cluster_sheets(c)
    assert sheets["centers"].count() == 4 * c.k and sheets["silhouette_grid"].count() == 2
    assert sheets["sizes"].agg(F.sum(sheets["sizes"].columns[-1])).first()[0] == 150
