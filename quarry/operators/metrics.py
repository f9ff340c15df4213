"""Evaluation metrics as aggregates.

Inputs are prediction DataFrames; every metric is a grouped aggregate over
them (partial aggregation on executors). Threshold curves and rank metrics
use distributed prefix sums over distinct scores (``functions.prefix``).
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.functions.exprs import col, to_double
from quarry.functions.quantiles import grouped_quantiles
from quarry.functions.prefix import prefix_sums
from quarry.operators.split import bin_by_edges

EPS = float(np.finfo(np.float64).eps)


# ------------------------------------------------------------------ regression

def regression_metrics(df: DataFrame, y: str, pred: str, group: Sequence[str] = (),
                       median: bool = True) -> DataFrame:
    """R2, explained variance, MSE, RMSE, MAE, median AE, max error, MAPE
    per group. R2/EV follow the usual finite convention for constant y. With the exact
    median the pairs are read by several passes, so they are kept while those run and
    the rows (one per group) come back evaluated; ``median=False`` stays one lazy pass."""
    yv, pv = to_double(y), to_double(pred)
    pairs = df.where(yv.isNotNull() & pv.isNotNull()).select(*[col(g) for g in group], yv.alias("__y"), pv.alias("__p"))
    e = F.col("__y") - F.col("__p")
    if median:
        pairs = pairs.persist(StorageLevel.MEMORY_AND_DISK)
    agg = (pairs
           .groupBy(*[col(g) for g in group])
           .agg(F.count(F.lit(1)).alias("n"),
                F.avg(e * e).alias("mse"),
                F.avg(F.abs(e)).alias("mae"),
                F.var_pop("__y").alias("_vy"),
                F.var_pop(e).alias("_ve"),
                F.max(F.abs(e)).alias("max_error"),
                F.avg(F.abs(e) / F.greatest(F.abs("__y"), F.lit(EPS))).alias("mape")))
    if median:
        got = grouped_quantiles(pairs, [F.abs(e)], [0.5], group)
        rows = [(*r, got[tuple(r[g] for g in group)][0][0] if r["n"] else None) for r in agg.collect()]
        schema = StructType([*agg.schema.fields, StructField("median_ae", DoubleType())])
        agg = df.sparkSession.createDataFrame(rows, schema)
        pairs.unpersist()

    def finite_ratio(num: Column) -> Column:
        return (F.when(F.col("_vy") > 0, F.lit(1.0) - num / F.col("_vy"))
                .when(num == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return agg.select(*group, "n", finite_ratio(F.col("mse")).alias("r2"),
                      finite_ratio(F.col("_ve")).alias("explained_variance"),
                      "mse", F.sqrt("mse").alias("rmse"), "mae", *(["median_ae"] if median else []), "max_error", "mape")


def regression_scores(df: DataFrame, y: str, preds: Sequence[Column], group: Sequence[str] = ()) -> list[dict[tuple, tuple]]:
    """Per prediction {group: (R2, RMSE, MAE)} as of ``regression_metrics``, of any number
    of predictions in ONE pass. The driver reads a row per group."""
    d = df.select(*[col(g) for g in group], to_double(y).alias("__y"), *[to_double(p).alias(f"__p{i}") for i, p in enumerate(preds)])
    aggs = []
    for i in range(len(preds)):
        e = F.col("__y") - F.col(f"__p{i}")
        aggs += [F.count(e).alias(f"n{i}"), F.avg(e * e).alias(f"s{i}"), F.avg(F.abs(e)).alias(f"a{i}"),
                 F.var_pop(F.when(F.col(f"__p{i}").isNotNull(), F.col("__y"))).alias(f"v{i}")]
    out: list[dict] = [{} for _ in preds]
    for r in d.groupBy(*[col(g) for g in group]).agg(*aggs).collect():
        for i, scores in enumerate(out):
            n, mse, mae, var = (r[f"{x}{i}"] for x in "nsav")
            if n or not group:
                r2 = 1.0 - mse / var if n and not var <= 0 else 1.0 if mse == 0 else 0.0
                scores[tuple(r[g] for g in group)] = (r2, None if mse is None else float(np.sqrt(mse)), mae)
    return out


def overall_row(metrics: DataFrame, name_col: str, value_cols: Sequence[str],
                nan_skip: Sequence[str] = ("mape",), digits: int | None = 3) -> DataFrame:
    """Append the mean over targets as an 'Overall' row (optionally rounded half-even)."""
    over = metrics.agg(*[F.avg(F.nanvl(col(c), F.lit(None).cast("double")) if c in nan_skip
                               else col(c)).alias(c) for c in value_cols])
    over = over.select(F.lit("Overall").alias(name_col), *value_cols)
    out = metrics.select(col(name_col).cast("string").alias(name_col), *value_cols).unionByName(over)
    if digits is not None:
        out = out.select(name_col, *[F.bround(col(c), digits).alias(c) for c in value_cols])
    return out


def spread_over_targets(metrics: DataFrame, cols: Sequence[str] = ("rmse", "mae")) -> DataFrame:
    """Population sd across targets (NULL when there is a single target)."""
    return metrics.agg(*[F.when(F.count(col(c)) > 1, F.stddev_pop(col(c))).alias(f"{c}_sd") for c in cols])


def metrics_by_bin(df: DataFrame, y: str, pred: str, bin_col: str) -> DataFrame:
    """R2, MSE, RMSE, MAE and n per stratum/quantile group."""
    return regression_metrics(df, y, pred, group=[bin_col], median=False).select(
        bin_col, "n", "r2", "mse", "rmse", "mae")


# ------------------------------------------------------------------ classification

def confusion_counts(df: DataFrame, y: str, pred: str, classes: Sequence[str]) -> DataFrame:
    """Classes x classes counts, zero cells kept (classes is the label order)."""
    spark = df.sparkSession
    names = F.array(*[F.lit(c) for c in classes])
    grid = (spark.createDataFrame([(c, i) for i, c in enumerate(classes)], "actual string, actual_idx int")
            .withColumn("predicted_idx", F.explode(F.sequence(F.lit(0), F.lit(len(classes) - 1))))
            .withColumn("predicted", F.element_at(names, F.col("predicted_idx") + 1)))
    counts = (df.groupBy(col(y).cast("string").alias("actual"), col(pred).cast("string").alias("predicted"))
              .agg(F.count(F.lit(1)).alias("count")))
    return (grid.join(counts, ["actual", "predicted"], "left")
            .select("actual", "predicted", "actual_idx", "predicted_idx",
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def normalize_confusion(cm: DataFrame, how: str = "true") -> DataFrame:
    """E8 normalisation over rows ('true'), columns ('pred') or all cells."""
    if how == "all":
        tot = cm.agg(F.sum("count")).first()[0]
        return cm.withColumn("share", F.try_divide(F.col("count"), F.lit(tot)))
    key = "actual" if how == "true" else "predicted"
    tot = cm.groupBy(key).agg(F.sum("count").alias("t"))
    return cm.join(F.broadcast(tot), key).withColumn("share", F.try_divide(F.col("count"), F.col("t"))).drop("t")


def per_class_stats(df: DataFrame, y: str, pred: str, classes: Sequence[str]) -> DataFrame:
    """Support, tp, fp, fn, precision, recall, f1 per class (0 on empty).

    One ``groupBy(actual, predicted)`` count; per-class sums are taken on
    that small table and joined to the class list (one row per class)."""
    spark = df.sparkSession
    pairs = df.groupBy(col(y).cast("string").alias("a"), col(pred).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    sup = pairs.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("support"))
    npred = pairs.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("npred"))
    tp = pairs.where(F.col("a") == F.col("p")).groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("tp"))
    cls = spark.createDataFrame([(c, i) for i, c in enumerate(classes)], "class string, class_idx int")
    j = (cls.join(sup, "class", "left").join(npred, "class", "left").join(tp, "class", "left")
         .select("class", "class_idx", F.coalesce("support", F.lit(0)).cast("long").alias("support"),
                 F.coalesce("tp", F.lit(0)).cast("long").alias("tp"),
                 F.coalesce("npred", F.lit(0)).cast("long").alias("npred")))
    s_, t_, np_ = F.col("support"), F.col("tp"), F.col("npred")
    fp, fn = np_ - t_, s_ - t_
    return j.select(
        "class", "class_idx", "support", "tp", fp.alias("fp"), fn.alias("fn"),
        F.coalesce(F.try_divide(t_, np_), F.lit(0.0)).cast("double").alias("precision"),
        F.coalesce(F.try_divide(t_, s_), F.lit(0.0)).cast("double").alias("recall"),
        F.coalesce(F.try_divide(2 * t_, 2 * t_ + fp + fn), F.lit(0.0)).cast("double").alias("f1"))


def classification_summary(df: DataFrame, y: str, pred: str, classes: Sequence[str],
                           with_n: bool = False) -> DataFrame:
    """Accuracy and precision/recall/F1 x macro, micro, weighted (one row)."""
    pc = per_class_stats(df, y, pred, classes)
    n = F.sum("support")
    agg = pc.agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), n.alias("n"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        F.try_divide(F.sum(F.col("precision") * F.col("support")), n).alias("precision_weighted"),
        F.try_divide(F.sum(F.col("recall") * F.col("support")), n).alias("recall_weighted"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), n).alias("f1_weighted"))
    micro_p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    micro_r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    micro_f = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    accuracy = F.try_divide(F.col("tp").cast("double"), F.col("n"))
    return agg.select(
        accuracy.alias("accuracy"), "precision_macro", micro_p.cast("double").alias("precision_micro"), "precision_weighted",
        "recall_macro", micro_r.cast("double").alias("recall_micro"), "recall_weighted",
        "f1_macro", micro_f.cast("double").alias("f1_micro"), "f1_weighted", *(["n"] if with_n else []))


def classification_report(df: DataFrame, y: str, pred: str, classes: Sequence[str]) -> DataFrame:
    """Per-class rows + accuracy, macro avg, weighted avg (long rows)."""
    pc = per_class_stats(df, y, pred, classes).select(
        F.col("class").alias("label"), "precision", "recall", "f1", F.col("support").cast("long"))
    s = classification_summary(df, y, pred, classes, with_n=True)
    tail = s.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), F.col("accuracy").alias("precision"),
                 F.col("accuracy").alias("recall"), F.col("accuracy").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("precision_macro").alias("precision"),
                 F.col("recall_macro").alias("recall"), F.col("f1_macro").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("precision_weighted").alias("precision"),
                 F.col("recall_weighted").alias("recall"), F.col("f1_weighted").alias("f1"),
                 F.col("n").alias("support")))).alias("s")).select("s.*")
    return pc.unionByName(tail)


# ------------------------------------------------------------------ scores

def stack_scores(df: DataFrame, y: str, score_cols: dict[str, str]) -> DataFrame:
    """(class, score, hit) long rows from per-class score columns."""
    parts = [F.struct(F.lit(c).alias("class"), to_double(sc).alias("score"),
                      (col(y).cast("string") == F.lit(c)).cast("long").alias("hit"))
             for c, sc in score_cols.items()]
    return df.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def _score_cells(long: DataFrame) -> DataFrame:
    """Distinct (class, score) cells with positive / negative counts."""
    return long.groupBy("class", "score").agg(F.sum("hit").alias("pos"),
                                              F.sum(F.lit(1) - F.col("hit")).alias("neg"))


def _pooled_with(cells: DataFrame, name: str) -> DataFrame:
    """The cells and, as class ``name``, those of all classes together."""
    pooled = cells.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return (cells.select("class", "score", "pos", "neg")
            .unionByName(pooled.withColumn("class", F.lit(name))))


def rank_metrics(long: DataFrame, with_micro: bool = False) -> DataFrame:
    """E9-E11 per class from ONE prefix-sum pass over distinct scores:
    (class, roc_auc, average_precision, support).

    AUC = sum_s pos_s * (negatives below s + 0.5 * negatives at s) / (P N);
    AP  = sum_s pos_s / P * precision at threshold s (scores descending).
    ``with_micro`` adds the pooled '__micro__' class in the same pass.
    """
    cells = _score_cells(long)
    if with_micro:  # the pooled class from the cells, not from the rows again
        cells = _pooled_with(cells, "__micro__")
    # the distinct-score table feeds four jobs; keep it while they run
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    pre = prefix_sums(cells, "score", ["pos", "neg"], group="class", descending=True, inclusive=True)
    tot = cells.groupBy("class").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = pre.join(F.broadcast(tot), "class")  # one row per class
    below = F.col("N") - F.col("neg_cum")
    rows = (j.groupBy("class", "P", "N")
            .agg(F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))).alias("u"),
                 F.sum(F.when(F.col("pos") > 0, F.col("pos") / F.col("P") * F.col("pos_cum")
                              / (F.col("pos_cum") + F.col("neg_cum"))).otherwise(F.lit(0.0))).alias("ap"))
            .select("class", F.try_divide(F.col("u"), F.col("P") * F.col("N")).alias("roc_auc"),
                    F.when(F.col("P") > 0, F.col("ap")).alias("average_precision"),
                    F.col("P").cast("long").alias("support"))
            .collect())  # one row per class: evaluate now, then release the cache
    cells.unpersist()
    return long.sparkSession.createDataFrame(
        [tuple(r) for r in rows], "class string, roc_auc double, average_precision double, support long")


def roc_auc_by_class(long: DataFrame) -> DataFrame:
    """E9/E10 per class: AUC = P(score_pos > score_neg) + 0.5 P(tie)."""
    return rank_metrics(long).select("class", "roc_auc", "support")


def average_precision_by_class(long: DataFrame) -> DataFrame:
    """E11 per class: sum over distinct thresholds of (R_k - R_(k-1)) * P_k."""
    return rank_metrics(long).select("class", "average_precision")


def auc_ap_summary(long: DataFrame) -> DataFrame:
    """E10/E11 macro, weighted and micro (pooled) AUC and AP, one row."""
    per = rank_metrics(long, with_micro=True)
    cls = per.where(F.col("class") != "__micro__")
    micro = per.where(F.col("class") == "__micro__").select(
        F.lit(1).alias("__one"), F.col("roc_auc").alias("roc_auc_micro"),
        F.col("average_precision").alias("average_precision_micro"))
    agg = cls.agg(F.lit(1).alias("__one"), F.avg("roc_auc").alias("roc_auc_macro"),
                  F.try_divide(F.sum(F.col("roc_auc") * F.col("support")), F.sum("support")).alias("roc_auc_weighted"),
                  F.avg("average_precision").alias("average_precision_macro"),
                  F.try_divide(F.sum(F.col("average_precision") * F.col("support")),
                               F.sum("support")).alias("average_precision_weighted"))
    return agg.join(micro, "__one").drop("__one")


MICRO = "micro"


def _curve_cells(long: DataFrame):
    """Distinct scores with running counts, per class and pooled over all (MICRO); and
    the totals, a row per class."""
    cells = _pooled_with(_score_cells(long), MICRO).persist(StorageLevel.MEMORY_AND_DISK)
    pre = prefix_sums(cells, "score", ["pos", "neg"], group="class", descending=True, inclusive=True)
    tot = cells.groupBy("class").agg(F.sum("pos").alias("P"), F.sum(F.col("neg")).alias("N"))
    return cells, pre.join(F.broadcast(tot), "class"), tot


def _materialise(df: DataFrame, cached: DataFrame) -> DataFrame:
    """Write the result to the shared checkpoint folder, then drop the cache."""
    from quarry.session import cut_lineage
    out = cut_lineage(df)
    cached.unpersist()
    return out


def _end_point(tot: DataFrame, **values: float) -> DataFrame:
    """The point above every score: nothing predicted, no threshold."""
    return tot.select("class", F.lit(None).cast("double").alias("threshold"), *[F.lit(v).alias(k) for k, v in values.items()])


def roc_curve(long: DataFrame) -> DataFrame:
    """(class, threshold, fpr, tpr) at every distinct score, descending, after
    (0, 0); class MICRO pools all classes."""
    cells, j, tot = _curve_cells(long)
    points = j.select("class", F.col("score").alias("threshold"),
                      F.try_divide(F.col("neg_cum"), F.col("N")).alias("fpr"),
                      F.try_divide(F.col("pos_cum"), F.col("P")).alias("tpr"))
    return _materialise(points.unionByName(_end_point(tot, fpr=0.0, tpr=0.0)), cells)


def pr_curve(long: DataFrame) -> DataFrame:
    """(class, threshold, precision, recall) at every distinct score, and recall 0
    at precision 1; class MICRO pools all classes."""
    cells, j, tot = _curve_cells(long)
    points = j.select("class", F.col("score").alias("threshold"),
                      F.try_divide(F.col("pos_cum"), F.col("pos_cum") + F.col("neg_cum")).alias("precision"),
                      F.try_divide(F.col("pos_cum"), F.col("P")).alias("recall"))
    return _materialise(points.unionByName(_end_point(tot, precision=1.0, recall=0.0)), cells)


def calibration_curve(long: DataFrame, n_bins: int = 10) -> DataFrame:
    """Uniform bins (right-closed inner edges), mean score and hit rate."""
    inner = list(np.linspace(0.0, 1.0, n_bins + 1)[1:-1])
    b = bin_by_edges(F.col("score"), inner)
    return (long.groupBy("class", b.alias("bin"))
            .agg(F.avg("score").alias("mean_predicted"), F.avg(F.col("hit").cast("double")).alias("fraction_positive"),
                 F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------------ clustering

def _centroids(df: DataFrame, feats: Sequence[str], label: str) -> DataFrame:
    return df.groupBy(col(label).alias("__c")).agg(
        F.count(F.lit(1)).alias("__n"), *[F.avg(to_double(f)).alias(f"__m{i}") for i, f in enumerate(feats)])


def cluster_scores(df: DataFrame, feats: Sequence[str], label: str, noise_label=None) -> DataFrame:
    """E17/E18 (+ sizes): Calinski-Harabasz and Davies-Bouldin in O(n k).

    Per-cluster centroids are a k-row table joined back by broadcast; DB's
    pairwise step runs on the k x k centroid table.
    """
    data = df if noise_label is None else df.where(col(label) != F.lit(noise_label))
    cent = _centroids(data, feats, label)
    k_rows = cent.collect()  # k rows: one per cluster
    k = len(k_rows)
    n = sum(r["__n"] for r in k_rows)
    spark = df.sparkSession
    if k < 2 or n <= k:
        return spark.createDataFrame([(k, n, None, None)],
                                     "n_clusters long, n_samples long, calinski_harabasz double, davies_bouldin double")
    M = np.array([[r[f"__m{i}"] for i in range(len(feats))] for r in k_rows], float)
    sizes = np.array([r["__n"] for r in k_rows], float)
    mu = (M * sizes[:, None]).sum(0) / n
    B = float((sizes * ((M - mu) ** 2).sum(1)).sum())
    joined = data.join(F.broadcast(cent), col(label) == F.col("__c"))
    sq = sum(((to_double(f) - F.col(f"__m{i}")) ** 2 for i, f in enumerate(feats)), F.lit(0.0))
    per = joined.groupBy("__c").agg(F.sum(sq).alias("w"), F.avg(F.sqrt(sq)).alias("s")).collect()
    W = sum(r["w"] for r in per)
    s = {r["__c"]: r["s"] for r in per}
    ch = (B / (k - 1)) / (W / (n - k)) if W > 0 else 1.0
    svec = np.array([s[r["__c"]] for r in k_rows])
    D = np.sqrt(((M[:, None, :] - M[None, :, :]) ** 2).sum(-1))
    if np.allclose(svec, 0) or np.allclose(D, 0):
        db_zero = True
    else:
        db_zero = False
    D[D == 0] = np.inf
    R = (svec[:, None] + svec[None, :]) / D
    db = 0.0 if db_zero else float(np.mean(np.max(R, axis=1)))
    return spark.createDataFrame([(k, int(n), float(ch), db)],
                                 "n_clusters long, n_samples long, calinski_harabasz double, davies_bouldin double")


def silhouette_squared(df: DataFrame, feats: Sequence[str], label: str) -> DataFrame:
    """The mean of ``silhouette_rows``; null for fewer than two clusters."""
    return silhouette_rows(df, feats, label, "silhouette_sq").agg(F.avg("silhouette_sq").alias("silhouette_sq"))


def silhouette_rows(df: DataFrame, feats: Sequence[str], label: str, out_col: str = "silhouette_sq") -> DataFrame:
    """E16 per row (squared-Euclidean form, O(n k)): a(i), b(i) from per-cluster
    sums of x and |x|^2; reported under its own name, never as the Euclidean one.

    Per-cluster sums are one grouped pass (k rows); each row's mean squared
    distance to cluster c is n_c |x|^2 - 2 x.S_c + Q_c, computed with array
    higher-order functions so the plan stays O(k) whatever the dimension.
    """
    vec = F.array(*[to_double(f) for f in feats])
    base = df.withColumn("__c", col(label)).withColumn("__v", vec)
    sq = F.aggregate(F.transform("__v", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    stats = base.groupBy("__c").agg(F.count(F.lit(1)).alias("n"), F.sum(sq).alias("q"),
                                    *[F.sum(F.col("__v")[i]).alias(f"s{i}") for i in range(len(feats))])
    rows = stats.collect()  # k rows
    if len(rows) < 2:
        return df.withColumn(out_col, F.lit(None).cast("double"))
    w = base.withColumn("__xx", sq)
    mean_d = []
    for r in rows:
        S = F.array(*[F.lit(float(r[f"s{i}"])) for i in range(len(feats))])
        dot = F.aggregate(F.zip_with("__v", S, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        total = F.lit(float(r["n"])) * F.col("__xx") - F.lit(2.0) * dot + F.lit(float(r["q"]))
        own = F.col("__c") == F.lit(r["__c"])
        mean_d.append((own, F.when(own, F.try_divide(total, F.lit(float(r["n"] - 1))))
                       .otherwise(total / F.lit(float(r["n"]))), r["n"]))
    a = F.coalesce(*[F.when(o, d) for o, d, _ in mean_d])
    b = F.least(*[F.when(~o, d) for o, d, _ in mean_d])
    own_n = F.coalesce(*[F.when(o, F.lit(n_)) for o, _, n_ in mean_d])
    s = F.when(own_n <= 1, F.lit(0.0)).otherwise(F.try_divide(b - a, F.greatest(a, b)))
    return w.withColumn(out_col, s).drop("__c", "__v", "__xx")
