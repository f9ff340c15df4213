import numpy as np
from pyspark.sql import functions as F

from quarry.operators import metrics


def _brute_auc(s, h):
    pos, neg = s[h == 1], s[h == 0]
    d = pos[:, None] - neg[None, :]
    return ((d > 0).sum() + 0.5 * (d == 0).sum()) / (len(pos) * len(neg))


def _brute_ap(s, h):
    out, P = 0.0, h.sum()
    for t in np.unique(s):
        sel = s >= t
        tp, fp = h[sel].sum(), (1 - h[sel]).sum()
        pos_at = h[s == t].sum()
        if pos_at:
            out += pos_at / P * tp / (tp + fp)
    return out


def test_auc_ap_vs_brute_force(spark):
    rng = np.random.default_rng(1)
    s = np.round(rng.normal(size=400), 1)  # ties on purpose
    h = (rng.random(400) < 0.3 + 0.2 * (s > 0)).astype(int)
    long = spark.createDataFrame([("c", float(a), int(b)) for a, b in zip(s, h)], "class string, score double, hit long")
    r = metrics.rank_metrics(long).first()
    assert np.isclose(r["roc_auc"], _brute_auc(s, h))
    assert np.isclose(r["average_precision"], _brute_ap(s, h))


def test_regression_metrics_vs_numpy(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=100) * 10 + 3
    p = y + rng.normal(size=100)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    r = metrics.regression_metrics(df, "y", "p").first()
    e = y - p
    assert np.isclose(r["r2"], 1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert np.isclose(r["mae"], np.abs(e).mean()) and np.isclose(r["median_ae"], np.median(np.abs(e)))
    assert np.isclose(r["max_error"], np.abs(e).max())


def test_constant_target_r2(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert metrics.regression_metrics(df, "y", "p").first()["r2"] == 1.0


def test_classification_summary_and_confusion(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(rows, "y string, p string")
    s = metrics.classification_summary(df, "y", "p", ["a", "b", "c"]).first()
    assert np.isclose(s["accuracy"], 3 / 5)
    # per class precision: a 1/2, b 2/3, c 0 ; recall: a 1/2, b 1, c 0
    assert np.isclose(s["precision_macro"], (0.5 + 2 / 3 + 0) / 3)
    assert np.isclose(s["recall_weighted"], (0.5 * 2 + 1 * 2 + 0) / 5)
    cm = {(r["actual"], r["predicted"]): r["count"] for r in metrics.confusion_counts(df, "y", "p", ["a", "b", "c"]).collect()}
    assert len(cm) == 9 and cm[("c", "a")] == 1 and cm[("c", "c")] == 0


def test_cluster_scores_vs_numpy(spark):
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(0, 1, (30, 2)), rng.normal(5, 1, (30, 2))])
    lab = np.array([0] * 30 + [1] * 30)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(X, lab)], "x double, y double, l int")
    r = metrics.cluster_scores(df, ["x", "y"], "l").first()
    c = np.array([X[lab == k].mean(0) for k in (0, 1)])
    mu = X.mean(0)
    B = sum(30 * ((c[k] - mu) ** 2).sum() for k in (0, 1))
    W = sum(((X[lab == k] - c[k]) ** 2).sum() for k in (0, 1))
    assert np.isclose(r["calinski_harabasz"], (B / 1) / (W / 58))
    s = [np.linalg.norm(X[lab == k] - c[k], axis=1).mean() for k in (0, 1)]
    assert np.isclose(r["davies_bouldin"], (s[0] + s[1]) / np.linalg.norm(c[0] - c[1]))
