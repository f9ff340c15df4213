"""Registered CV / batch queries (T6, T9, T10, A16-A18) with SQL twins, and
rows-only queries for model families without an SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import cluster, linear, metrics, neighbors, split, transform
from quarry.plans import batch, models, tune
from quarry.plans.catalog_models import REG_METRICS_SQL, solve_sql
from quarry.plans.common import LI_FEATS, LI_KEYS, LI_TARGET, SEED, sig_all, t
from quarry.plans.registry import HASH, LI_KEYS_SQL, SIG, register

K = LI_KEYS_SQL


# ------------------------------------------------------------------ T6 cross-validation (OLS)

def _cv_sql(k: int = 5) -> str:
    xs = LI_FEATS
    p = len(xs)
    stats = ["count(*) AS n", f"avg({LI_TARGET}) AS my"]
    for i, a in enumerate(xs):
        stats += [f"avg({a}) AS m{i}", f"covar_pop({a}, {LI_TARGET}) AS cy{i}"]
        for j in range(i, p):
            stats.append(f"covar_pop({a}, {xs[j]}) AS c{i}_{j}")
    A = [[f"c{min(i, j)}_{max(i, j)}" for j in range(p)] for i in range(p)]
    w = solve_sql(A, [f"cy{i}" for i in range(p)])
    coef_cols = ", ".join(f"{c} AS b{i}" for i, c in enumerate(w))
    pred = " + ".join(f"b{i} * d.{a}" for i, a in enumerate(xs))
    icpt = " - ".join(["my"] + [f"b{i} * m{i}" for i in range(p)])
    return f"""WITH h AS (SELECT *, {HASH(SEED, LI_KEYS)} AS h FROM lineitem),
r AS (SELECT *, row_number() OVER (ORDER BY h) - 1 AS rk, count(*) OVER () AS nn FROM h),
d AS (SELECT *, CAST(CASE WHEN rk < (nn % {k}) * (nn // {k} + 1) THEN rk // (nn // {k} + 1)
                     ELSE (nn % {k}) + (rk - (nn % {k}) * (nn // {k} + 1)) // (nn // {k}) END AS INTEGER) AS fold
      FROM r),
fs AS (SELECT CAST(range AS INTEGER) AS f FROM range({k})),
st AS (SELECT fs.f AS fold, {', '.join(stats)} FROM fs JOIN d ON d.fold <> fs.f GROUP BY fs.f),
co AS (SELECT *, {coef_cols} FROM st),
pr AS (SELECT d.fold AS split, d.{LI_TARGET} AS y, d.{LI_TARGET} - (({icpt}) + {pred}) AS e
       FROM d JOIN co ON d.fold = co.fold),
m AS ({REG_METRICS_SQL})
SELECT split AS fold, r2, rmse, mae FROM m"""


@register("t6_cv_ols_lineitem", _cv_sql(5))
def q_t6(spark, sf):
    folds, _ = tune.cross_validate(t(spark, sf, "lineitem"), LI_FEATS, LI_TARGET, "Linear", LI_KEYS, 5, seed=SEED)
    return sig_all(folds, 8)


# ------------------------------------------------------------------ T9 / A16-A18 multi-seed robustness

SEEDS = [1, 2, 3, 4, 5]


def _seed_sql() -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in LI_KEYS)
    return f"""s AS (SELECT * FROM (VALUES {', '.join(f'({x})' for x in SEEDS)}) v(seed)),
h AS (SELECT s.seed, l.l_quantity AS x, l.{LI_TARGET} AS y,
             md5(concat_ws('|', CAST(s.seed AS VARCHAR), {parts})) AS h FROM lineitem l CROSS JOIN s),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY h) - 1 AS rk,
             count(*) OVER (PARTITION BY seed) AS n FROM h),
sp AS (SELECT *, CASE WHEN rk < ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM r),
st AS (SELECT seed, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM sp WHERE split = 'train' GROUP BY seed),
pr AS (SELECT sp.seed, y, y - (a + b * x) AS e FROM sp JOIN st USING (seed) WHERE split = 'test'),
ps AS (SELECT CAST(seed AS INTEGER) AS seed,
         CASE WHEN var_pop(y) > 0 THEN 1 - avg(e * e) / var_pop(y) ELSE 0.0 END AS test_r2,
         sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM pr GROUP BY seed)"""


def per_seed_ols(spark, sf):
    li = t(spark, sf, "lineitem")
    parts = []
    for seed in SEEDS:
        sp = split.train_test_split(li, LI_KEYS, 0.2, seed)
        m = linear.fit(sp.where(F.col("split") == "train"), ["l_quantity"], LI_TARGET, "ols")
        r = metrics.regression_metrics(m.transform(sp.where(F.col("split") == "test")), LI_TARGET, "prediction")
        parts.append(r.select(F.lit(seed).alias("seed"), F.col("r2").alias("test_r2"), "rmse", "mae"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("t9_robustness_ols_lineitem", f"""WITH {_seed_sql()}
SELECT seed, {SIG('test_r2')} AS test_r2, {SIG('rmse')} AS rmse, {SIG('mae')} AS mae FROM ps""")
def q_t9(spark, sf):
    return sig_all(per_seed_ols(spark, sf), 8)


def _summary_sql() -> str:
    cols = []
    for c in ("test_r2", "rmse", "mae"):
        cols += [f"{SIG(f'quantile_cont({c}, 0.5)')} AS {c}_median", f"{SIG(f'avg({c})')} AS {c}_mean",
                 f"{SIG(f'stddev_samp({c})')} AS {c}_sd", f"{SIG(f'quantile_cont({c}, 0.025)')} AS {c}_p2_5",
                 f"{SIG(f'quantile_cont({c}, 0.975)')} AS {c}_p97_5"]
    return f"""WITH {_seed_sql()}
SELECT 'Linear' AS model, 'all' AS feature_set, count(*) AS n_seeds, {', '.join(cols)} FROM ps"""


@register("a16_seed_summary_ols_lineitem", _summary_sql())
def q_a16(spark, sf):
    per = per_seed_ols(spark, sf).withColumn("model", F.lit("Linear")).withColumn("feature_set", F.lit("all"))
    return sig_all(batch.summarize(per, value_cols=("test_r2", "rmse", "mae")), 8)


# The SQL twins of t9 and a16 fix one model on one feature; these run the whole of batch.robustness.
ROBUST_MODELS = ["Linear", "Ridge"]


def robustness_sets(spark, sf):
    return batch.robustness(t(spark, sf, "lineitem"), batch.feature_sets(LI_FEATS, "l_quantity"), LI_TARGET,
                            ROBUST_MODELS, SEEDS, LI_KEYS)


@register("t9_robustness_sets_lineitem")
def q_t9_sets(spark, sf):
    return sig_all(robustness_sets(spark, sf), 8)


@register("a16_seed_summary_sets_lineitem")
def q_a16_sets(spark, sf):
    return sig_all(batch.summarize(robustness_sets(spark, sf)), 8)


# ------------------------------------------------------------------ T10 external validation

@register("t10_external_ols_lineitem", f"""WITH
tr AS (SELECT l_quantity AS x, {LI_TARGET} AS y FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'),
ex AS (SELECT l_quantity AS x, {LI_TARGET} AS y FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01'),
w AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM tr),
fit0 AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM tr),
fit1 AS (SELECT regr_slope(y, least(greatest(x, lo), hi)) AS b, regr_intercept(y, least(greatest(x, lo), hi)) AS a
         FROM tr, w),
pr AS (SELECT 'Linear' AS split, y, y - (a + b * x) AS e FROM ex, fit0
       UNION ALL
       SELECT 'Linear:winsor', y, y - (a + b * least(greatest(x, lo), hi)) FROM ex, fit1, w)
SELECT split AS candidate, count(*) AS n,
       {SIG('CASE WHEN var_pop(y) > 0 THEN 1 - avg(e * e) / var_pop(y) ELSE 0.0 END')} AS r2,
       {SIG('sqrt(avg(e * e))')} AS rmse, {SIG('avg(abs(e))')} AS mae
FROM pr GROUP BY split""")
def q_t10(spark, sf):
    li = t(spark, sf, "lineitem")
    cut = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")  # wall-clock, session-TZ free
    out = batch.external_validation(li.where(cut), li.where(~cut), ["l_quantity"], LI_TARGET,
                                    ["Linear", "Linear:winsor"])
    return sig_all(out, 8)


# ------------------------------------------------------------------ rows-only model queries

@register("u10_kmeans_scan_embeddings")
def q_u10(spark, sf):
    e, feats = neighbors.vector_columns(t(spark, sf, "embeddings"), "embedding", 64)
    return cluster.scan_k(e, feats)


@register("r4_lasso_cv_lineitem")
def q_r4(spark, sf):
    li = t(spark, sf, "lineitem")
    trainer = models.make("LassoCV")
    trainer.keys = LI_KEYS
    m = trainer.fit(li, LI_FEATS, LI_TARGET)
    best, scores = m.info["alpha"], m.info["cv_mse"]
    fitted = (float(m.intercept), *[float(c) for c in m.coef])  # of the refit, beside its alpha
    empty = (None,) * len(fitted)
    return spark.createDataFrame([(float(a), float(e), bool(a == best), *(fitted if a == best else empty)) for a, e in scores.items()],
                                 "alpha double, cv_mse double, best boolean, intercept double, "
                                 + ", ".join(f"coef_{f} double" for f in LI_FEATS))


@register("f5_quantile_transform_lineitem")
def q_f5(spark, sf):
    sp = split.train_test_split(t(spark, sf, "lineitem"), LI_KEYS, 0.2, SEED).select(*LI_KEYS, "split", *LI_FEATS)
    m = transform.fit_quantile(sp.where(F.col("split") == "train"), LI_FEATS)
    return m.transform(sp, LI_FEATS)


# ------------------------------------------------------------------ X explanation tables and S17

from quarry.operators import explain  # noqa: E402
from quarry.plans.catalog_models import SPLIT_SQL  # noqa: E402
from quarry.sources import sinks  # noqa: E402


def _ols_coef_cte() -> str:
    xs = LI_FEATS
    p = len(xs)
    stats = ["count(*) AS n", f"avg({LI_TARGET}) AS my"]
    for i, a in enumerate(xs):
        stats += [f"avg({a}) AS m{i}", f"covar_pop({a}, {LI_TARGET}) AS cy{i}"]
        for j in range(i, p):
            stats.append(f"covar_pop({a}, {xs[j]}) AS c{i}_{j}")
    A = [[f"c{min(i, j)}_{max(i, j)}" for j in range(p)] for i in range(p)]
    w = solve_sql(A, [f"cy{i}" for i in range(p)])
    icpt = " - ".join(["my"] + [f"b{i} * m{i}" for i in range(p)])
    return f"""{SPLIT_SQL},
st AS (SELECT {', '.join(stats)} FROM sp WHERE split = 'train'),
co0 AS (SELECT *, {', '.join(f'{c} AS b{i}' for i, c in enumerate(w))} FROM st),
co AS (SELECT *, {icpt} AS b0x FROM co0)"""


def _ols_fit(spark, sf):
    sp = split.train_test_split(t(spark, sf, "lineitem"), LI_KEYS, 0.2, SEED)
    return sp, linear.fit(sp.where(F.col("split") == "train"), LI_FEATS, LI_TARGET, "ols")


_PRED_SQL = "b0x + " + " + ".join(f"b{i} * {a}" for i, a in enumerate(LI_FEATS))


@register("x7_residuals_lineitem", f"""WITH {_ols_coef_cte()}
SELECT {K}, split, {SIG(LI_TARGET)} AS actual, {SIG(_PRED_SQL)} AS predicted,
       {SIG(f'{LI_TARGET} - ({_PRED_SQL})', 6)} AS residual FROM sp, co""")
def q_x7(spark, sf):
    sp, m = _ols_fit(spark, sf)
    return _resid_sig(explain.residual_rows(m.transform(sp), LI_TARGET, "prediction", "split", keep=LI_KEYS))


def _resid_sig(df):
    from quarry.plans.common import sig
    return df.select(*LI_KEYS, "split", sig("actual", 8).alias("actual"), sig("predicted", 8).alias("predicted"),
                     sig("residual", 6).alias("residual"))


@register("x1_importance_ols_lineitem", f"""WITH {_ols_coef_cte()}
SELECT feature, {SIG('abs(b)')} AS importance FROM co,
  (SELECT * FROM (VALUES {', '.join(f"('{a}', {i})" for i, a in enumerate(LI_FEATS))}) v(feature, i)) f,
  LATERAL (SELECT CASE f.i {' '.join(f'WHEN {i} THEN b{i}' for i in range(len(LI_FEATS)))} END AS b)""")
def q_x1(spark, sf):
    _, m = _ols_fit(spark, sf)
    rows = explain.model_importance(m, LI_FEATS)
    return sig_all(spark.createDataFrame(rows, "feature string, importance double"), 8)


@register("x3_partial_dependence_lineitem", f"""WITH {_ols_coef_cte()},
q AS (SELECT quantile_cont(l_quantity, 0.05) AS lo, quantile_cont(l_quantity, 0.95) AS hi FROM sp),
g AS (SELECT CASE WHEN i = 49 THEN hi ELSE lo + i * ((hi - lo) / 49) END AS v
      FROM q, (SELECT range AS i FROM range(50))),
mx AS (SELECT avg(l_discount) AS md, avg(l_tax) AS mt FROM sp)
SELECT {SIG('v', 10)} AS value, {SIG('b0x + b0 * v + b1 * md + b2 * mt')} AS mean_prediction FROM g, co, mx""")
def q_x3(spark, sf):
    sp, m = _ols_fit(spark, sf)
    return sig_all(explain.partial_dependence(m, sp, "l_quantity", 50).select(
        sig_value("value"), "mean_prediction"), 8, skip=("value",))


def sig_value(c):
    from quarry.plans.common import sig
    return sig(c, 10).alias(c)


@register("s17_downsample_lineitem", f"""
WITH h AS (SELECT {K}, {HASH('order', LI_KEYS)} AS h FROM lineitem),
r AS (SELECT *, row_number() OVER (ORDER BY h) - 1 AS rk, count(*) OVER () AS n FROM h),
pos AS (SELECT DISTINCT (i * ((SELECT count(*) FROM lineitem) - 1)) // 499 AS p FROM (SELECT range AS i FROM range(500)))
SELECT {K} FROM r WHERE rk IN (SELECT p FROM pos)""")
def q_s17(spark, sf):
    li = t(spark, sf, "lineitem").select(*LI_KEYS)
    return sinks.downsample_evenly(li, LI_KEYS, 500).select(*LI_KEYS)


@register("x5_pca_embeddings")
def q_x5(spark, sf):
    e, feats = neighbors.vector_columns(t(spark, sf, "embeddings"), "embedding", 64)
    out, ratio = explain.pca2(e, feats)
    return out.select("vec_id", "label", "pc1", "pc2")


@register("i4_prediction_summary_lineitem", f"""WITH {_ols_coef_cte()},
pr AS (SELECT {_PRED_SQL} AS p FROM sp, co WHERE split = 'test')
SELECT 'Predicted_Target' AS column, count(p) AS n, {SIG('min(p)')} AS min, {SIG('max(p)')} AS max,
       {SIG('avg(p)')} AS mean, {SIG('CASE WHEN count(p) > 1 THEN stddev_samp(p) END')} AS sd,
       {SIG('quantile_cont(p, 0.25)')} AS p25, {SIG('quantile_cont(p, 0.5)')} AS p50,
       {SIG('quantile_cont(p, 0.75)')} AS p75, {SIG('quantile_cont(p, 1.0)')} AS p100 FROM pr""")
def q_i4(spark, sf):
    from quarry.plans.workflow import prediction_summary
    sp, m = _ols_fit(spark, sf)
    scored = m.transform(sp.where(F.col("split") == "test"), "Predicted_Target")
    return sig_all(prediction_summary(scored, "Predicted_Target"), 8)


# ------------------------------------------------------------------ rows-only: explanations, selection, clusterers

def _permuted_sql() -> str:
    """A row gets the value of the row whose rank by the repeat's hash equals its own rank."""
    parts = []
    for j, a in enumerate(LI_FEATS):
        pred = "b0x + " + " + ".join(f"b{i} * {'d.v' if i == j else 'te.' + x}" for i, x in enumerate(LI_FEATS))
        for rep in range(5):
            parts.append(f"""SELECT '{a}' AS feature, 1 - avg(power(te.{LI_TARGET} - ({pred}), 2)) / var_pop(te.{LI_TARGET}) AS r2
  FROM te JOIN (SELECT row_number() OVER (ORDER BY {HASH(f'{SEED}|{rep}', LI_KEYS)}) AS rk, {a} AS v FROM te) d ON d.rk = te.r0, co""")
    return " UNION ALL ".join(parts)


@register("x2_permutation_importance_lineitem", f"""WITH {_ols_coef_cte()},
te AS (SELECT *, row_number() OVER (ORDER BY {HASH('perm-base', LI_KEYS)}) AS r0 FROM sp WHERE split = 'test'),
base AS (SELECT 1 - avg(power({LI_TARGET} - ({_PRED_SQL}), 2)) / var_pop({LI_TARGET}) AS r2 FROM te, co),
runs AS ({_permuted_sql()})
SELECT feature, {SIG('avg(base.r2 - runs.r2)', 5)} AS importance_mean, {SIG('stddev_pop(base.r2 - runs.r2)', 5)} AS importance_sd
FROM runs, base GROUP BY feature""")
def q_x2(spark, sf):
    sp, m = _ols_fit(spark, sf)
    test = sp.where(F.col("split") == "test")
    return sig_all(explain.permutation_importance(m, test, LI_FEATS, LI_TARGET, LI_KEYS, "regression"), 5)


_SHAP_SQL = " UNION ALL ".join(f"SELECT '{a}' AS feature, avg(abs(b{i} * ({a} - c{i}))) AS v FROM te, co, mid" for i, a in enumerate(LI_FEATS))


@register("x4_shapley_lineitem", f"""WITH {_ols_coef_cte()},
te AS (SELECT * FROM sp WHERE split = 'test'),
mid AS (SELECT {', '.join(f'avg({a}) AS c{i}' for i, a in enumerate(LI_FEATS))} FROM te)
SELECT feature, {SIG('v', 6)} AS mean_abs_shap FROM ({_SHAP_SQL})""")
def q_x4(spark, sf):
    sp, m = _ols_fit(spark, sf)
    return sig_all(explain.kernel_shap(m, sp.where(F.col("split") == "test"), LI_FEATS, LI_KEYS, n_explain=None), 6)


@register("k4_select_from_model_lineitem")
def q_k4(spark, sf):
    from quarry.operators import select
    sp = split.train_test_split(t(spark, sf, "lineitem"), LI_KEYS, 0.2, SEED)
    return select.select_from_model(sp.where(F.col("split") == "train"), LI_FEATS + ["l_linenumber"],
                                    LI_TARGET, "regression")


@register("u1_cluster_models_embeddings")
def q_u1(spark, sf):
    e, feats = neighbors.vector_columns(t(spark, sf, "embeddings"), "embedding", 64)
    e = e.drop("embedding")
    fits = {"kmeans": lambda: cluster.kmeans(e, feats, 5),
            "bisecting_kmeans": lambda: cluster.bisecting_kmeans(e, feats, 5),
            "agglo": lambda: cluster.agglomerative(e, feats, 5),
            "birch": lambda: cluster.birch(e, feats, 5)}
    rows = []
    for name, fit in fits.items():
        lab = fit().transform(e, "cluster").persist()
        s = metrics.cluster_scores(lab, feats, "cluster").first()
        lab.unpersist()
        rows.append((name, int(s["n_clusters"]), s["calinski_harabasz"], s["davies_bouldin"]))
    return spark.createDataFrame(rows, "model string, n_clusters long, calinski_harabasz double, "
                                       "davies_bouldin double")
