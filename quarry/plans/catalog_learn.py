"""Registered queries of gradient-trained models, tree ensembles, discriminants, further
clusterers and sinks (R15, R20, R21, R29, R32, C3, C4, C20, E16, K3, S10, U2, U4, U8, U9, A9, X8, T12)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.operators import bayes, cluster, explain, metrics, profile, select, split, trees
from quarry.plans import models, workflow
from quarry.plans.catalog_batch import _PRED_SQL, _ols_coef_cte, _ols_fit
from quarry.plans.catalog_models import SPLIT_SQL, _linear_sql, solve_sql
from quarry.plans.catalog_space import EF, _sqd_sql, emb
from quarry.plans.common import LI_FEATS, LI_KEYS, LI_TARGET, SEED, sig, sig_all, t
from quarry.plans.registry import HASH, LI_KEYS_SQL, SIG, register
from quarry.session import ensure_checkpoint_dir
from quarry.sources import sinks

K = LI_KEYS_SQL


def _parts(spark, sf):
    sp = split.train_test_split(t(spark, sf, "lineitem"), LI_KEYS, 0.2, SEED)
    return sp, sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")


# ------------------------------------------------------------------ gradients

def _fit_sql(inner: str) -> str:
    return f"SELECT split, n, {SIG('r2', 5)} AS r2, {SIG('mse', 5)} AS mse, {SIG('mae', 4)} AS mae FROM ({inner})"


def _fit_rows(out):
    return out.select("split", "n", sig("r2", 5).alias("r2"), sig("mse", 5).alias("mse"), sig("mae", 4).alias("mae"))


# the least mean squared loss plus l2 / 2 times the squared weights is ridge with l2 * n rows of penalty
@register("r20_sgd_lineitem", _fit_sql(_linear_sql("1e-4 * n")))
def q_r20(spark, sf):
    sp, train, _ = _parts(spark, sf)
    m = models.make("SGD").fit(train, LI_FEATS, LI_TARGET)
    return _fit_rows(metrics.regression_metrics(m.transform(sp), LI_TARGET, "prediction", group=["split"]))


PA_STEPS, PA_C, PA_EPS = 5, 0.05, 0.1


def _aggressive_sql() -> str:
    p = len(LI_FEATS)
    dot = lambda s: " + ".join([f"b{s}"] + [f"w{s}_{i} * z{i}" for i in range(p)])
    names = lambda s: ", ".join([f"w{s}_{i}" for i in range(p)] + [f"b{s}"])
    stats = ", ".join(f"avg({a}) AS m{i}, stddev_pop({a}) AS s{i}" for i, a in enumerate(LI_FEATS))
    z = ", ".join(f"({a} - m{i}) / s{i} AS z{i}" for i, a in enumerate(LI_FEATS))
    norm = " + ".join(f"z{i} * z{i}" for i in range(p)) + " + 1"
    sql = f"""WITH {SPLIT_SQL},
st AS (SELECT {stats}, avg({LI_TARGET}) AS my, stddev_pop({LI_TARGET}) AS sy FROM sp WHERE split = 'train'),
d AS (SELECT split, {LI_TARGET} AS raw, my, sy, ({LI_TARGET} - my) / sy AS y, {z} FROM sp, st),
dn AS (SELECT *, {norm} AS nz FROM d WHERE split = 'train'),
p0 AS (SELECT {', '.join(f'0.0::DOUBLE AS w0_{i}' for i in range(p))}, 0.0::DOUBLE AS b0)"""
    for k in range(PA_STEPS):
        step = f"sign(y - ({dot(k)})) * least({PA_C}, greatest(abs(y - ({dot(k)})) - {PA_EPS}, 0) / nz)"
        new = ", ".join([f"any_value(w{k}_{i}) + avg({step} * z{i}) AS w{k + 1}_{i}" for i in range(p)] + [f"any_value(b{k}) + avg({step}) AS b{k + 1}"])
        sql += f""",
l{k} AS (SELECT avg(greatest(abs(y - ({dot(k)})) - {PA_EPS}, 0)) AS loss FROM dn, p{k}),
p{k + 1} AS (SELECT {new} FROM dn, p{k})"""
    n = PA_STEPS
    sql += f""",
l{n} AS (SELECT avg(greatest(abs(y - ({dot(n)})) - {PA_EPS}, 0)) AS loss FROM dn, p{n})"""
    every = " UNION ALL ".join(f"SELECT {k} AS k, loss, {names(k)} FROM l{k}, p{k}" for k in range(n + 1))
    return sql + f""",
best AS (SELECT * FROM ({every.replace(names(0), ', '.join([f'w0_{i} AS v{i}' for i in range(p)] + ['b0 AS c']), 1)}) ORDER BY loss, k LIMIT 1),
pr AS (SELECT split, raw - (my + sy * (c + {' + '.join(f'v{i} * z{i}' for i in range(p))})) AS e FROM d, best)
SELECT split, count(*) AS n, {SIG('avg(e * e)', 6)} AS mse, {SIG('avg(abs(e))', 6)} AS mae FROM pr GROUP BY split"""


@register("r21_passive_aggressive_lineitem", _aggressive_sql())
def q_r21(spark, sf):
    sp, train, _ = _parts(spark, sf)
    m = models.make("PassiveAggressive", {"C": PA_C, "epsilon": PA_EPS, "max_iter": PA_STEPS}).fit(train, LI_FEATS, LI_TARGET)
    out = metrics.regression_metrics(m.transform(sp), LI_TARGET, "prediction", group=["split"])
    return out.select("split", "n", sig("mse", 6).alias("mse"), sig("mae", 6).alias("mae"))


# ------------------------------------------------------------------ polynomial, discriminants

@register("r15_polynomial_lineitem", f"""WITH {SPLIT_SQL},
d AS (SELECT split, l_quantity AS a, l_quantity * l_quantity AS b, {LI_TARGET} AS y FROM sp),
st AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb,
              covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM d WHERE split = 'train'),
co AS (SELECT *, {', '.join(f'{c} AS w{i}' for i, c in enumerate(solve_sql([['aa', 'ab'], ['ab', 'bb']], ['ay', 'byy'])))} FROM st),
pr AS (SELECT split, y - (my + w0 * (a - ma) + w1 * (b - mb)) AS e FROM d, co)
SELECT split, count(*) AS n, {SIG('avg(e * e)', 7)} AS mse, {SIG('avg(abs(e))', 7)} AS mae FROM pr GROUP BY split""")
def q_r15(spark, sf):
    sp, train, _ = _parts(spark, sf)
    m = models.make("Polynomial", {"degree": 2}).fit(train, ["l_quantity"], LI_TARGET)
    out = metrics.regression_metrics(m.transform(sp), LI_TARGET, "prediction", group=["split"])
    return out.select("split", "n", sig("mse", 7).alias("mse"), sig("mae", 7).alias("mae"))


DA_FEATS = ["l_quantity", LI_TARGET]


def _discriminant_sql(pooled: bool) -> str:
    a, b = DA_FEATS
    cov = "aa, ab, bb"
    groups = f"""g AS (SELECT l_returnflag AS cls, count(*) AS n, avg({a}) AS ma, avg({b}) AS mb, covar_pop({a}, {a}) AS aa0,
  covar_pop({a}, {b}) AS ab0, covar_pop({b}, {b}) AS bb0 FROM sp WHERE split = 'train' GROUP BY l_returnflag),
"""
    if pooled:
        groups += f"""w AS (SELECT sum(n * aa0) / (sum(n) - count(*)) AS aa, sum(n * ab0) / (sum(n) - count(*)) AS ab,
  sum(n * bb0) / (sum(n) - count(*)) AS bb FROM g),
gg AS (SELECT g.*, {cov}, aa * bb - ab * ab AS det FROM g, w),"""
        extra = ""
    else:
        groups += """gg AS (SELECT *, aa * bb - ab * ab AS det FROM (SELECT *, n * aa0 / (n - 1) AS aa, n * ab0 / (n - 1) AS ab,
  n * bb0 / (n - 1) AS bb FROM g)),"""
        extra = " - 0.5 * ln(det)"
    score = (f"-0.5 * (bb * ({a} - ma) * ({a} - ma) - 2 * ab * ({a} - ma) * ({b} - mb) + aa * ({b} - mb) * ({b} - mb)) / det"
             f" + ln(n / (SELECT sum(n) FROM g)){extra}")
    return f"""WITH {SPLIT_SQL},
{groups}
j AS (SELECT {K}, cls, {score} AS s FROM sp, gg WHERE split = 'test')
SELECT {K}, arg_max(cls, s) AS prediction FROM j GROUP BY {K}"""


def _discriminant(fit):
    def q(spark, sf):
        _, train, test = _parts(spark, sf)
        return fit(train, DA_FEATS, "l_returnflag").transform(test).select(*LI_KEYS, "prediction")
    return q


register("c3_lda_lineitem", _discriminant_sql(True))(_discriminant(bayes.fit_lda))
register("c4_qda_lineitem", _discriminant_sql(False))(_discriminant(bayes.fit_qda))


# ------------------------------------------------------------------ trees

def _first_split_sql() -> str:
    cand = " UNION ALL ".join(
        f"""SELECT {i} AS f, v, (v + lead(v) OVER (ORDER BY v)) / 2 AS cut, sum(n) OVER w AS n, sum(s) OVER w AS s
  FROM (SELECT {a} AS v, count(*) AS n, sum(y) AS s FROM d GROUP BY {a}) WINDOW w AS (ORDER BY v)""" for i, a in enumerate(LI_FEATS))
    names = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(LI_FEATS))
    return f"""WITH {SPLIT_SQL},
tr AS (SELECT * FROM sp WHERE split = 'train'),
d AS (SELECT *, {LI_TARGET} - (SELECT avg({LI_TARGET}) FROM tr) AS y FROM tr),
al AS (SELECT count(*) AS nn, avg({LI_TARGET}) AS my, sum({LI_TARGET}) AS sy FROM tr),
c AS ({cand}),
b AS (SELECT *, s * s / n + s * s / (nn - n) AS gain FROM c, al WHERE cut IS NOT NULL AND n >= 20 AND nn - n >= 20 ORDER BY gain DESC LIMIT 1)
SELECT CASE f {names} END AS feature, {SIG('cut')} AS threshold, {SIG('my + s / n')} AS mean_left, {SIG('my - s / (nn - n)')} AS mean_right FROM b"""


@register("r32_hist_boosting_first_split_lineitem", _first_split_sql())
def q_r32_split(spark, sf):
    """The root of the first tree; a learning rate of 1 makes a leaf's value its mean residual."""
    _, train, _ = _parts(spark, sf)
    m = models.make("HistGradientBoosting", {"max_iter": 1, "max_leaf_nodes": 2, "learning_rate": 1.0}).fit(train, LI_FEATS, LI_TARGET)
    root = m.trees[0]
    row = (LI_FEATS[root["feature"][0]], root["threshold"][0], m.base[0] + root["value"][1], m.base[0] + root["value"][2])
    return sig_all(spark.createDataFrame([row], "feature string, threshold double, mean_left double, mean_right double"), 8)


def _losses(spark, m):
    return spark.createDataFrame(list(enumerate(map(float, m.info["loss"]))), "round int, mean_loss double")


@register("r32_hist_boosting_lineitem")
def q_r32(spark, sf):
    """Training loss by round: leaf-wise trees of up to 31 leaves."""
    _, train, _ = _parts(spark, sf)
    return _losses(spark, models.make("HistGradientBoosting", {"max_iter": 10}).fit(train, LI_FEATS, LI_TARGET))


@register("c20_softmax_boosting_lineitem")
def q_c20(spark, sf):
    """Training log loss by round: one tree per class and round."""
    _, train, _ = _parts(spark, sf)
    feats = [*LI_FEATS, LI_TARGET]
    return _losses(spark, models.make("GradientBoosting_classifier", {"n_estimators": 5}).fit(train, feats, "l_returnflag"))


@register("r29_extra_trees_lineitem")
def q_r29(spark, sf):
    sp, train, _ = _parts(spark, sf)
    m = trees.extra_trees(train, LI_FEATS, LI_TARGET, "regression", 10, max_depth=6)
    return metrics.regression_metrics(m.transform(sp), LI_TARGET, "prediction", group=["split"])


# ------------------------------------------------------------------ clusters

@register("e16_silhouette_rows_embeddings", f"""WITH
pd AS (SELECT a.vec_id, a.label AS la, b.label AS lb, {_sqd_sql('a', 'b')} AS d2
       FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
m AS (SELECT vec_id, la, lb, sum(d2) AS s FROM pd GROUP BY vec_id, la, lb),
ab AS (SELECT vec_id, la, max(CASE WHEN la = lb THEN s / (n.n - 1) END) AS a, min(CASE WHEN la <> lb THEN s / n.n END) AS b
       FROM m JOIN n ON n.label = m.lb GROUP BY vec_id, la)
SELECT vec_id, label, round(CASE WHEN n.n <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette_sq
FROM ab JOIN n ON n.label = ab.la""")
def q_e16_rows(spark, sf):
    out = metrics.silhouette_rows(emb(spark, sf), EF, "label")
    return out.select("vec_id", "label", F.round("silhouette_sq", 6).alias("silhouette_sq"))


@register("u2_more_cluster_models_embeddings")
def q_u2(spark, sf):
    """Mini-batch k-means, Gaussian mixture (on the two main components) and spectral clustering."""
    e = emb(spark, sf)
    flat = explain.fit_pca(e, EF).transform(e)
    parts = {"minibatch_kmeans": cluster.minibatch_kmeans(e, EF, 5, steps=10).transform(e, "cluster"),
             "gmm": cluster.gaussian_mixture(flat, ["pc1", "pc2"], 3).transform(cluster._vec(flat, ["pc1", "pc2"])),
             "spectral": cluster.spectral(e, "vec_id", EF, 3)}
    out = None
    for name, lab in parts.items():
        one = lab.groupBy(F.col("cluster").cast("long").alias("cluster")).count().select(F.lit(name).alias("model"), "cluster", "count")
        out = one if out is None else out.union(one)
    return out


@register("u9_mean_shift_part")
def q_u9(spark, sf):
    pt = t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x1"), (F.col("p_retailprice") / 40.0).alias("x2"))
    return cluster.mean_shift(pt, ["x1", "x2"], 8.0).transform(pt, "cluster").select("p_partkey", "cluster")


# ------------------------------------------------------------------ selection, views, sinks

@register("k3_rfe_lineitem")
def q_k3(spark, sf):
    _, train, _ = _parts(spark, sf)
    return select.rfe(train, LI_FEATS + ["l_linenumber"], LI_TARGET, 2, n_trees=20)


@register("s10_predictions_lineitem", f"""WITH {_ols_coef_cte()}
SELECT {K}, {SIG(_PRED_SQL)} AS "Predicted_Target" FROM sp, co WHERE split = 'test'""")
def q_s10(spark, sf):
    """Predictions as they are read back from the file that was written."""
    sp, m = _ols_fit(spark, sf)
    scored = m.transform(sp.where(F.col("split") == "test"), "Predicted_Target").select(*LI_KEYS, "Predicted_Target")
    path = sinks.write_predictions(scored, f"{ensure_checkpoint_dir(spark)}/predictions-{uuid.uuid4().hex}", "parquet")
    return spark.read.parquet(path).select(*LI_KEYS, sig("Predicted_Target").alias("Predicted_Target"))


@register("x8_scoring_overlay_lineitem", f"""WITH {_ols_coef_cte()},
pr AS (SELECT *, {_PRED_SQL} AS p FROM sp, co),
r AS (SELECT *, row_number() OVER (ORDER BY {HASH('order', LI_KEYS)}) - 1 AS place FROM pr WHERE l_linestatus = 'F'),
pos AS (SELECT DISTINCT (i * ((SELECT count(*) FROM r) - 1)) // 499 AS place FROM (SELECT range AS i FROM range(500)))
SELECT {SIG(LI_TARGET)} AS actual, {SIG('p')} AS predicted, split AS series FROM r WHERE place IN (SELECT place FROM pos)
UNION ALL SELECT {SIG('p')}, {SIG('p')}, 'scored' FROM pr WHERE l_linestatus = 'O'""")
def q_x8(spark, sf):
    """Points of the known rows beside predictions of the others."""
    sp, m = _ols_fit(spark, sf)
    out = m.transform(sp)
    known = out.where("l_linestatus = 'F'").select(*LI_KEYS, F.col(LI_TARGET).alias("actual"), F.col("prediction").alias("predicted"), "split")
    return sig_all(explain.scoring_overlay(known, out.where("l_linestatus = 'O'"), "prediction", LI_KEYS), 8)


@register("a9_pair_view_part")
def q_a9(spark, sf):
    pts, hx, hy = profile.pair_view(t(spark, sf, "part"), "p_size", "p_retailprice")
    sizes = [d.select(F.lit(n).alias("part"), F.lit(1).alias("one")) for n, d in (("points", pts), ("x", hx), ("y", hy))]
    return sizes[0].union(sizes[1]).union(sizes[2]).groupBy("part").count()


@register("t12_baseline_vs_advanced_lineitem")
def q_t12(spark, sf):
    roles = workflow.Roles(LI_FEATS, [LI_TARGET], LI_KEYS)
    return workflow.baseline_vs_advanced(t(spark, sf, "lineitem"), roles, workflow.TrainConfig(outlier_method="IQR"))
