"""Registered model queries with SQL twins: Gram-family regression (R1, R2),
Gaussian naive Bayes (C5) and the metrics computed on their predictions
(E1-E14, A15)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import bayes, linear, metrics, split
from quarry.plans.common import LI_FEATS, LI_KEYS, LI_TARGET, SEED, sig_all, t
from quarry.plans.registry import HASH, LI_KEYS_SQL, SIG, register

K = LI_KEYS_SQL
NB_FEATS = ["l_quantity", "l_discount", "l_tax", LI_TARGET]
NB_CLASSES = ["A", "N", "R"]  # Fixed values: l_returnflag levels in label order

SPLIT_SQL = f"""sp AS (
  SELECT *, CASE WHEN rk < ceil(0.2::DOUBLE * nrows) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY h) - 1 AS rk, count(*) OVER () AS nrows
        FROM (SELECT *, {HASH(SEED, LI_KEYS)} AS h FROM lineitem)))"""


def _split_li(spark, sf):
    return split.train_test_split(t(spark, sf, "lineitem"), LI_KEYS, 0.2, SEED)


# ------------------------------------------------------------------ SQL generators

def det_sql(M: list[list[str]]) -> str:
    n = len(M)
    if n == 1:
        return f"({M[0][0]})"
    if n == 2:
        return f"(({M[0][0]}) * ({M[1][1]}) - ({M[0][1]}) * ({M[1][0]}))"
    terms = []
    for j in range(n):
        minor = [row[:j] + row[j + 1:] for row in M[1:]]
        terms.append(f"{'+' if j % 2 == 0 else '-'} ({M[0][j]}) * {det_sql(minor)}")
    return "(" + " ".join(terms) + ")"


def solve_sql(A: list[list[str]], b: list[str]) -> list[str]:
    """Cramer's rule: SQL expressions for x in A x = b."""
    d = det_sql(A)
    out = []
    for i in range(len(b)):
        Ai = [row[:i] + [b[r]] + row[i + 1:] for r, row in enumerate(A)]
        out.append(f"({det_sql(Ai)} / {d})")
    return out


REG_METRICS_SQL = f"""SELECT split, count(*) AS n,
  {SIG('CASE WHEN var_pop(y) > 0 THEN 1 - avg(e * e) / var_pop(y) WHEN avg(e * e) = 0 THEN 1.0 ELSE 0.0 END')} AS r2,
  {SIG('CASE WHEN var_pop(y) > 0 THEN 1 - var_pop(e) / var_pop(y) WHEN var_pop(e) = 0 THEN 1.0 ELSE 0.0 END')}
      AS explained_variance,
  {SIG('avg(e * e)')} AS mse, {SIG('sqrt(avg(e * e))')} AS rmse, {SIG('avg(abs(e))')} AS mae,
  {SIG('quantile_cont(abs(e), 0.5)')} AS median_ae, {SIG('max(abs(e))')} AS max_error,
  {SIG('avg(abs(e) / greatest(abs(y), 2.220446049250313e-16))')} AS mape
FROM pr GROUP BY split"""


def _linear_sql(ridge_alpha: float | None) -> str:
    xs = LI_FEATS
    p = len(xs)
    stats = [f"count(*) AS n", f"avg({LI_TARGET}) AS my", f"stddev_pop({LI_TARGET}) AS sy"]
    for i, a in enumerate(xs):
        stats += [f"avg({a}) AS m{i}", f"stddev_pop({a}) AS s{i}", f"covar_pop({a}, {LI_TARGET}) AS cy{i}"]
        for j in range(i, p):
            stats.append(f"covar_pop({a}, {xs[j]}) AS c{i}_{j}")
    if ridge_alpha is None:
        A = [[f"c{min(i, j)}_{max(i, j)}" for j in range(p)] for i in range(p)]
        b = [f"cy{i}" for i in range(p)]
        w = solve_sql(A, b)
        coefs = w
    else:
        A = [[f"c{min(i, j)}_{max(i, j)} / (s{i} * s{j})" + (f" + {ridge_alpha} / n" if i == j else "")
              for j in range(p)] for i in range(p)]
        b = [f"cy{i} / (s{i} * sy)" for i in range(p)]
        w = solve_sql(A, b)
        coefs = [f"{w[i]} * sy / s{i}" for i in range(p)]
    coef_cols = ", ".join(f"{c} AS b{i}" for i, c in enumerate(coefs))
    pred = " + ".join(f"b{i} * {a}" for i, a in enumerate(xs))
    icpt = " - ".join(["my"] + [f"b{i} * m{i}" for i in range(p)])
    return f"""WITH {SPLIT_SQL},
st AS (SELECT {', '.join(stats)} FROM sp WHERE split = 'train'),
co AS (SELECT *, {coef_cols} FROM st),
pr AS (SELECT split, {LI_TARGET} AS y, {LI_TARGET} - (({icpt}) + {pred}) AS e FROM sp, co)
{REG_METRICS_SQL}"""


def _linear_q(method: str, **kw):
    def q(spark, sf):
        sp = _split_li(spark, sf)
        model = linear.fit(sp.where(F.col("split") == "train"), LI_FEATS, LI_TARGET, method, **kw)
        out = metrics.regression_metrics(model.transform(sp), LI_TARGET, "prediction", group=["split"])
        return sig_all(out, 8)
    return q


register("r1_ols_lineitem", _linear_sql(None))(_linear_q("ols"))
register("r2_ridge_lineitem", _linear_sql(1.0))(_linear_q("ridge", alpha=1.0))


# ------------------------------------------------------------------ A15 metrics per quantile bin

@register("a15_metrics_by_quantile_lineitem", f"""WITH {SPLIT_SQL},
st AS (SELECT regr_slope({LI_TARGET}, l_quantity) AS b, regr_intercept({LI_TARGET}, l_quantity) AS a
       FROM sp WHERE split = 'train'),
e AS (SELECT quantile_cont({LI_TARGET}, 0.25) AS e1, quantile_cont({LI_TARGET}, 0.5) AS e2,
             quantile_cont({LI_TARGET}, 0.75) AS e3 FROM sp WHERE split = 'test'),
pr AS (SELECT CAST(({LI_TARGET} > e1)::INT + ({LI_TARGET} > e2)::INT + ({LI_TARGET} > e3)::INT AS INTEGER) AS split,
              {LI_TARGET} AS y, {LI_TARGET} - (a + b * l_quantity) AS e
       FROM sp, st, e WHERE sp.split = 'test'),
m AS ({REG_METRICS_SQL})
SELECT split AS bin, n, r2, mse, rmse, mae FROM m""")
def q_a15(spark, sf):
    sp = _split_li(spark, sf)
    model = linear.fit(sp.where(F.col("split") == "train"), ["l_quantity"], LI_TARGET, "ols")
    test = model.transform(sp.where(F.col("split") == "test"))
    from quarry.functions.quantiles import column_quantiles
    edges = column_quantiles(test, [LI_TARGET], [0.25, 0.5, 0.75])[LI_TARGET]
    binned = test.withColumn("bin", split.bin_by_edges(F.col(LI_TARGET), edges))
    return sig_all(metrics.metrics_by_bin(binned, LI_TARGET, "prediction", "bin"), 8)


# ------------------------------------------------------------------ C5 Gaussian NB + classification metrics

def _nb_sql_cte() -> str:
    xs = NB_FEATS
    eps = f"1e-9 * greatest({', '.join(f'var_pop({x})' for x in xs)})"
    cls_stats = ", ".join(f"avg({x}) AS m{i}, var_pop({x}) + (SELECT ev FROM eps) AS v{i}" for i, x in enumerate(xs))
    jll = (" - ".join([f"ln(n / (SELECT sum(n) FROM cs))"]
                      + [f"0.5 * ln(2 * pi() * v{i})" for i in range(len(xs))]
                      + [f"0.5 * ({x} - m{i}) * ({x} - m{i}) / v{i}" for i, x in enumerate(xs)]))
    probs = ", ".join(f"max(CASE WHEN cls = '{c}' THEN p END) AS prob_{c}" for c in NB_CLASSES)
    return f"""{SPLIT_SQL},
eps AS (SELECT {eps} AS ev FROM sp WHERE split = 'train'),
cs AS (SELECT l_returnflag AS cls, count(*) AS n, {cls_stats} FROM sp WHERE split = 'train' GROUP BY l_returnflag),
j AS (SELECT {K}, l_returnflag AS y, cls, {jll} AS jll FROM sp, cs WHERE split = 'test'),
jm AS (SELECT *, exp(jll - max(jll) OVER (PARTITION BY {K})) AS ex,
              row_number() OVER (PARTITION BY {K} ORDER BY jll DESC, cls) AS pos FROM j),
jp AS (SELECT *, ex / sum(ex) OVER (PARTITION BY {K}) AS p FROM jm),
nb AS (SELECT {K}, y, max(CASE WHEN pos = 1 THEN cls END) AS prediction, {probs}
       FROM jp GROUP BY {K}, y)"""


NB_CTE = _nb_sql_cte()


def nb_predictions(spark, sf):
    sp = _split_li(spark, sf)
    model = bayes.fit_gaussian_nb(sp.where(F.col("split") == "train"), NB_FEATS, "l_returnflag")
    test = sp.where(F.col("split") == "test")
    return model.transform(test).select(*LI_KEYS, F.col("l_returnflag").alias("y"), "prediction",
                                        *[f"prob_{c}" for c in NB_CLASSES])


@register("c5_gaussian_nb_lineitem", f"""WITH {NB_CTE}
SELECT {K}, y, prediction, {', '.join(f"{SIG(f'prob_{c}', 8)} AS prob_{c}" for c in NB_CLASSES)} FROM nb""")
def q_c5(spark, sf):
    return sig_all(nb_predictions(spark, sf), 8)


_PC_SQL = f"""pc AS (
  SELECT c.cls AS class, CAST(c.idx AS INTEGER) AS class_idx,
         count(*) FILTER (WHERE y = c.cls) AS support,
         count(*) FILTER (WHERE y = c.cls AND prediction = c.cls) AS tp,
         count(*) FILTER (WHERE y <> c.cls AND prediction = c.cls) AS fp
  FROM nb, (SELECT * FROM (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(NB_CLASSES))}) v(cls, idx)) c
  GROUP BY c.cls, c.idx),
pcs AS (SELECT class, class_idx, support, tp, fp, support - tp AS fn,
         coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
         coalesce(tp / nullif(support, 0), 0.0) AS recall,
         coalesce(2 * tp / nullif(2 * tp + fp + support - tp, 0), 0.0) AS f1 FROM pc)"""


@register("e6_per_class_nb_lineitem", f"""WITH {NB_CTE}, {_PC_SQL}
SELECT class, class_idx, support, tp, fp, fn, {SIG('precision')} AS precision, {SIG('recall')} AS recall,
       {SIG('f1')} AS f1 FROM pcs""")
def q_e6(spark, sf):
    return sig_all(metrics.per_class_stats(nb_predictions(spark, sf), "y", "prediction", NB_CLASSES), 8)


_SUMMARY_SQL = f"""sm AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(support) AS n,
  avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro,
  sum(precision * support) / sum(support) AS precision_weighted,
  sum(recall * support) / sum(support) AS recall_weighted,
  sum(f1 * support) / sum(support) AS f1_weighted FROM pcs)"""


@register("e5_classification_summary_nb_lineitem", f"""WITH {NB_CTE}, {_PC_SQL}, {_SUMMARY_SQL}
SELECT {SIG('tp / n')} AS accuracy, {SIG('precision_macro')} AS precision_macro,
  {SIG('coalesce(tp / nullif(tp + fp, 0), 0.0)')} AS precision_micro, {SIG('precision_weighted')} AS precision_weighted,
  {SIG('recall_macro')} AS recall_macro, {SIG('coalesce(tp / nullif(tp + fn, 0), 0.0)')} AS recall_micro,
  {SIG('recall_weighted')} AS recall_weighted, {SIG('f1_macro')} AS f1_macro,
  {SIG('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)')} AS f1_micro, {SIG('f1_weighted')} AS f1_weighted
FROM sm""")
def q_e5(spark, sf):
    return sig_all(metrics.classification_summary(nb_predictions(spark, sf), "y", "prediction", NB_CLASSES), 8)


@register("e7_classification_report_nb_lineitem", f"""WITH {NB_CTE}, {_PC_SQL}, {_SUMMARY_SQL}
SELECT class AS label, {SIG('precision')} AS precision, {SIG('recall')} AS recall, {SIG('f1')} AS f1, support FROM pcs
UNION ALL SELECT 'accuracy', {SIG('tp / n')}, {SIG('tp / n')}, {SIG('tp / n')}, n FROM sm
UNION ALL SELECT 'macro avg', {SIG('precision_macro')}, {SIG('recall_macro')}, {SIG('f1_macro')}, n FROM sm
UNION ALL SELECT 'weighted avg', {SIG('precision_weighted')}, {SIG('recall_weighted')}, {SIG('f1_weighted')}, n FROM sm""")
def q_e7(spark, sf):
    return sig_all(metrics.classification_report(nb_predictions(spark, sf), "y", "prediction", NB_CLASSES), 8)


@register("e8_confusion_nb_lineitem", f"""WITH {NB_CTE},
c AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(NB_CLASSES))}) v(cls, idx)),
cnt AS (SELECT y, prediction, count(*) AS n FROM nb GROUP BY y, prediction)
SELECT a.cls AS actual, b.cls AS predicted, CAST(a.idx AS INTEGER) AS actual_idx,
       CAST(b.idx AS INTEGER) AS predicted_idx, coalesce(cnt.n, 0) AS count
FROM c a CROSS JOIN c b LEFT JOIN cnt ON cnt.y = a.cls AND cnt.prediction = b.cls""")
def q_e8(spark, sf):
    return metrics.confusion_counts(nb_predictions(spark, sf), "y", "prediction", NB_CLASSES)


# ------------------------------------------------------------------ E9-E14 score metrics

_LONG_SQL = "lg AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS class, prob_{c} AS score, CAST(y = '{c}' AS BIGINT) AS hit FROM nb" for c in NB_CLASSES) + ")"


def _nb_long(spark, sf):
    return metrics.stack_scores(nb_predictions(spark, sf), "y", {c: f"prob_{c}" for c in NB_CLASSES})


def _auc_sql(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT class, (sum(CASE WHEN hit = 1 THEN rk END) - sum(hit) * (sum(hit) + 1) / 2.0)
                / (sum(hit) * (count(*) - sum(hit))) AS roc_auc, sum(hit) AS support
  FROM (SELECT class, hit, rank() OVER (PARTITION BY class ORDER BY score)
               + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS rk FROM {src})
  GROUP BY class)"""


def _ap_sql(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT class, CASE WHEN max(P) > 0 THEN sum(CASE WHEN pos > 0 THEN pos / P * tp / (tp + fp) ELSE 0 END) END
         AS average_precision
  FROM (SELECT class, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS P
        FROM (SELECT class, score, sum(hit) AS pos, sum(1 - hit) AS neg FROM {src} GROUP BY class, score)
        WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  GROUP BY class)"""


@register("e10_auc_ap_nb_lineitem", f"""WITH {NB_CTE}, {_LONG_SQL},
mlg AS (SELECT '__micro__' AS class, score, hit FROM lg),
{_auc_sql('lg', 'auc')}, {_ap_sql('lg', 'ap')}, {_auc_sql('mlg', 'mauc')}, {_ap_sql('mlg', 'map')}
SELECT {SIG('avg(auc.roc_auc)')} AS roc_auc_macro,
       {SIG('sum(auc.roc_auc * auc.support) / sum(auc.support)')} AS roc_auc_weighted,
       {SIG('avg(ap.average_precision)')} AS average_precision_macro,
       {SIG('sum(ap.average_precision * auc.support) / sum(auc.support)')} AS average_precision_weighted,
       {SIG('(SELECT roc_auc FROM mauc)')} AS roc_auc_micro,
       {SIG('(SELECT average_precision FROM map)')} AS average_precision_micro
FROM auc JOIN ap USING (class)""")
def q_e10(spark, sf):
    return sig_all(metrics.auc_ap_summary(_nb_long(spark, sf)), 8)


@register("e11_auc_ap_per_class_nb_lineitem", f"""WITH {NB_CTE}, {_LONG_SQL}, {_auc_sql('lg', 'auc')}, {_ap_sql('lg', 'ap')}
SELECT class, {SIG('roc_auc')} AS roc_auc, support, {SIG('average_precision')} AS average_precision
FROM auc JOIN ap USING (class)""")
def q_e11(spark, sf):
    out = metrics.rank_metrics(_nb_long(spark, sf))
    return sig_all(out.select("class", "roc_auc", "support", "average_precision"), 8)


_CURVE_CELLS = f"""cells AS (
  SELECT class, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER (PARTITION BY class) AS P, sum(neg) OVER (PARTITION BY class) AS N
  FROM (SELECT class, score, sum(hit) AS pos, sum(1 - hit) AS neg
        FROM (SELECT class, score, hit FROM lg UNION ALL SELECT 'micro', score, hit FROM lg) GROUP BY class, score)
  WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@register("e12_roc_curve_nb_lineitem", f"""WITH {NB_CTE}, {_LONG_SQL}, {_CURVE_CELLS}
SELECT class, {SIG('score', 10)} AS threshold, {SIG('fp / N', 10)} AS fpr, {SIG('tp / P', 10)} AS tpr FROM cells
UNION ALL SELECT DISTINCT class, CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM cells""")
def q_e12(spark, sf):
    return sig_all(metrics.roc_curve(_nb_long(spark, sf)), 10)


@register("e13_pr_curve_nb_lineitem", f"""WITH {NB_CTE}, {_LONG_SQL}, {_CURVE_CELLS}
SELECT class, {SIG('score', 10)} AS threshold, {SIG('tp / (tp + fp)', 10)} AS precision,
       {SIG('tp / P', 10)} AS recall FROM cells
UNION ALL SELECT DISTINCT class, CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE FROM cells""")
def q_e13(spark, sf):
    return sig_all(metrics.pr_curve(_nb_long(spark, sf)), 10)


_CAL_EDGES = [float(x) for x in np.linspace(0.0, 1.0, 11)[1:-1]]


@register("e14_calibration_nb_lineitem", f"""WITH {NB_CTE}, {_LONG_SQL}
SELECT class, CAST({' + '.join(f'(score > {e!r}::DOUBLE)::INT' for e in _CAL_EDGES)} AS INTEGER) AS bin,
       {SIG('avg(score)')} AS mean_predicted, {SIG('avg(hit)')} AS fraction_positive, count(*) AS n
FROM lg GROUP BY 1, 2""")
def q_e14(spark, sf):
    return sig_all(metrics.calibration_curve(_nb_long(spark, sf)), 8)


@register("e9_auc_binary_documents", f"""WITH lg AS (
  SELECT '1' AS class, CAST(d.n_chars AS DOUBLE) AS score, CAST(l.quality = 1 AS BIGINT) AS hit
  FROM labels l JOIN documents d USING (doc_id)),
{_auc_sql('lg', 'auc')}, {_ap_sql('lg', 'ap')}
SELECT {SIG('roc_auc')} AS roc_auc, {SIG('average_precision')} AS average_precision FROM auc JOIN ap USING (class)""")
def q_e9(spark, sf):
    lab, doc = t(spark, sf, "labels"), t(spark, sf, "documents")
    joined = lab.join(doc.select("doc_id", "n_chars"), "doc_id")
    long = metrics.stack_scores(joined, "quality", {"1": "n_chars"})
    return sig_all(metrics.rank_metrics(long).select("roc_auc", "average_precision"), 8)


# ------------------------------------------------------------------ C6-C8 count-based naive Bayes

def _nb_linear_sql(kind: str) -> str:
    """Test-row predictions of multinomial / complement / Bernoulli NB (alpha 1)."""
    xs = NB_FEATS
    if kind == "bernoulli":
        sums = ", ".join(f"sum(CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END) AS s{i}" for i, x in enumerate(xs))
    else:
        sums = ", ".join(f"sum({x}) AS s{i}" for i, x in enumerate(xs))
    cs = f"cs AS (SELECT l_returnflag AS cls, count(*) AS n, {sums} FROM sp WHERE split = 'train' GROUP BY l_returnflag)"
    if kind == "multinomial":
        tot = " + ".join(f"(s{i} + 1.0)" for i in range(len(xs)))
        w = ", ".join(f"ln(s{i} + 1.0) - ln({tot}) AS w{i}" for i in range(len(xs)))
        par = f"par AS (SELECT cls, ln(n / (SELECT sum(n) FROM cs)) AS b, {w} FROM cs)"
        score = " + ".join(f"w{i} * {x}" for i, x in enumerate(xs))
    elif kind == "complement":
        comp = [f"((SELECT sum(s{i}) FROM cs) - s{i} + 1.0)" for i in range(len(xs))]
        tot = " + ".join(comp)
        w = ", ".join(f"-ln({c} / ({tot})) AS w{i}" for i, c in enumerate(comp))
        par = f"par AS (SELECT cls, 0.0 AS b, {w} FROM cs)"
        score = " + ".join(f"w{i} * {x}" for i, x in enumerate(xs))
    else:
        p = [f"((s{i} + 1.0) / (n + 2.0))" for i in range(len(xs))]
        w = ", ".join(f"ln({pi}) - ln(1 - {pi}) AS w{i}" for i, pi in enumerate(p))
        base = " + ".join(f"ln(1 - {pi})" for pi in p)
        par = f"par AS (SELECT cls, ln(n / (SELECT sum(n) FROM cs)) + {base} AS b, {w} FROM cs)"
        score = " + ".join(f"w{i} * CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END" for i, x in enumerate(xs))
    return f"""WITH {SPLIT_SQL}, {cs}, {par},
j AS (SELECT {K}, l_returnflag AS y, cls, b + {score} AS jll FROM sp, par WHERE split = 'test')
SELECT {K}, y, prediction FROM (
  SELECT {K}, y, cls AS prediction, row_number() OVER (PARTITION BY {K} ORDER BY jll DESC, cls) AS pos FROM j)
WHERE pos = 1"""


def _nb_linear_q(fitter):
    def q(spark, sf):
        sp = _split_li(spark, sf)
        model = fitter(sp.where(F.col("split") == "train"), NB_FEATS, "l_returnflag")
        return (model.transform(sp.where(F.col("split") == "test"), with_probs=False)
                .select(*LI_KEYS, F.col("l_returnflag").alias("y"), "prediction"))
    return q


register("c6_multinomial_nb_lineitem", _nb_linear_sql("multinomial"))(_nb_linear_q(bayes.fit_multinomial_nb))
register("c7_complement_nb_lineitem", _nb_linear_sql("complement"))(_nb_linear_q(bayes.fit_complement_nb))
register("c8_bernoulli_nb_lineitem", _nb_linear_sql("bernoulli"))(_nb_linear_q(bayes.fit_bernoulli_nb))


# ------------------------------------------------------------------ C2 ridge classifier, C9 categorical NB

def _ridge_clf_sql(alpha: float = 1.0) -> str:
    xs = NB_FEATS
    p = len(xs)
    stats = ["count(*) AS n"]
    for i, a in enumerate(xs):
        stats += [f"avg({a}) AS m{i}", f"stddev_pop({a}) AS s{i}"]
        for j in range(i, p):
            stats.append(f"covar_pop({a}, {xs[j]}) AS c{i}_{j}")
    ycls = [f"CASE WHEN l_returnflag = '{c}' THEN 1.0 ELSE -1.0 END" for c in NB_CLASSES]
    for k, yc in enumerate(ycls):
        stats.append(f"avg({yc}) AS my{k}")
        stats += [f"covar_pop({a}, {yc}) AS cy{k}_{i}" for i, a in enumerate(xs)]
    A = [[f"n * c{min(i, j)}_{max(i, j)} / (s{i} * s{j})" + (f" + {alpha}" if i == j else "") for j in range(p)]
         for i in range(p)]
    cols = []
    for k in range(len(NB_CLASSES)):
        w = solve_sql(A, [f"n * cy{k}_{i} / s{i}" for i in range(p)])
        cols += [f"{w[i]} / s{i} AS b{k}_{i}" for i in range(p)]
    co = f"co AS (SELECT *, {', '.join(cols)} FROM st)"
    scores = []
    for k, c in enumerate(NB_CLASSES):
        icpt = " - ".join([f"my{k}"] + [f"b{k}_{i} * m{i}" for i in range(p)])
        lin = " + ".join(f"b{k}_{i} * {a}" for i, a in enumerate(xs))
        scores.append(f"SELECT {K}, l_returnflag AS y, '{c}' AS cls, ({icpt}) + {lin} AS jll FROM sp, co "
                      f"WHERE split = 'test'")
    return f"""WITH {SPLIT_SQL},
st AS (SELECT {', '.join(stats)} FROM sp WHERE split = 'train'),
{co},
j AS ({' UNION ALL '.join(scores)})
SELECT {K}, y, prediction FROM (
  SELECT {K}, y, cls AS prediction, row_number() OVER (PARTITION BY {K} ORDER BY jll DESC, cls) AS pos FROM j)
WHERE pos = 1"""


@register("c2_ridge_classifier_lineitem", _ridge_clf_sql(1.0))
def q_c2(spark, sf):
    from quarry.plans.models import RidgeClassifierTrainer
    sp = _split_li(spark, sf)
    model = RidgeClassifierTrainer(1.0).fit(sp.where(F.col("split") == "train"), NB_FEATS, "l_returnflag")
    return (model.transform(sp.where(F.col("split") == "test"), with_probs=False)
            .select(*LI_KEYS, F.col("l_returnflag").alias("y"), "prediction"))


_CAT_FEATS = ["l_linestatus", "l_linenumber"]


@register("c9_categorical_nb_lineitem", f"""WITH {SPLIT_SQL},
tr AS (SELECT l_returnflag AS cls, CAST(l_linestatus AS VARCHAR) AS f0, CAST(l_linenumber AS VARCHAR) AS f1
       FROM sp WHERE split = 'train'),
nc AS (SELECT cls, count(*) AS n FROM tr GROUP BY cls),
lv AS (SELECT 0 AS f, count(DISTINCT f0) AS L FROM tr UNION ALL SELECT 1, count(DISTINCT f1) FROM tr),
cnt AS (SELECT cls, 0 AS f, f0 AS lvl, count(*) AS c FROM tr GROUP BY cls, f0
        UNION ALL SELECT cls, 1, f1, count(*) FROM tr GROUP BY cls, f1),
te AS (SELECT {K}, l_returnflag AS y, CAST(l_linestatus AS VARCHAR) AS f0, CAST(l_linenumber AS VARCHAR) AS f1
       FROM sp WHERE split = 'test'),
j AS (SELECT te.*, nc.cls, ln(nc.n / (SELECT sum(n) FROM nc))
        + ln((coalesce(c0.c, 0) + 1.0) / (nc.n + (SELECT L FROM lv WHERE f = 0)))
        + ln((coalesce(c1.c, 0) + 1.0) / (nc.n + (SELECT L FROM lv WHERE f = 1))) AS jll
      FROM te CROSS JOIN nc
      LEFT JOIN cnt c0 ON c0.cls = nc.cls AND c0.f = 0 AND c0.lvl = te.f0
      LEFT JOIN cnt c1 ON c1.cls = nc.cls AND c1.f = 1 AND c1.lvl = te.f1)
SELECT {K}, y, prediction FROM (
  SELECT {K}, y, cls AS prediction, row_number() OVER (PARTITION BY {K} ORDER BY jll DESC, cls) AS pos FROM j)
WHERE pos = 1""")
def q_c9(spark, sf):
    sp = _split_li(spark, sf)
    model = bayes.fit_categorical_nb(sp.where(F.col("split") == "train"), _CAT_FEATS, "l_returnflag")
    return (model.transform(sp.where(F.col("split") == "test"), with_probs=False)
            .select(*LI_KEYS, F.col("l_returnflag").alias("y"), "prediction"))


# ------------------------------------------------------------------ E3 / A19 overall row, A20 spread

_MULTI = [("l_extendedprice", "l_quantity"), ("l_quantity", "l_discount")]  # (target, feature)
_MCOLS = ["r2", "explained_variance", "mse", "rmse", "mae", "median_ae", "max_error", "mape"]


def _multi_target_metrics(spark, sf):
    sp = _split_li(spark, sf)
    tr, te = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
    parts = []
    for tgt, x in _MULTI:
        m = linear.fit(tr, [x], tgt, "ols")
        parts.append(metrics.regression_metrics(m.transform(te), tgt, "prediction").withColumn("Target", F.lit(tgt)))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


def _multi_sql() -> str:
    blocks = []
    for tgt, x in _MULTI:
        blocks.append(f"""SELECT '{tgt}' AS target, y, e FROM (
  SELECT {tgt} AS y, {tgt} - (a + b * {x}) AS e FROM sp,
    (SELECT regr_slope({tgt}, {x}) AS b, regr_intercept({tgt}, {x}) AS a FROM sp WHERE split = 'train')
  WHERE split = 'test')""")
    return f"""{SPLIT_SQL},
pr AS ({' UNION ALL '.join(blocks)}),
mt AS (SELECT target,
  CASE WHEN var_pop(y) > 0 THEN 1 - avg(e * e) / var_pop(y) WHEN avg(e * e) = 0 THEN 1.0 ELSE 0.0 END AS r2,
  CASE WHEN var_pop(y) > 0 THEN 1 - var_pop(e) / var_pop(y) WHEN var_pop(e) = 0 THEN 1.0 ELSE 0.0 END
      AS explained_variance,
  avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, quantile_cont(abs(e), 0.5) AS median_ae,
  max(abs(e)) AS max_error, avg(abs(e) / greatest(abs(y), 2.220446049250313e-16)) AS mape
  FROM pr GROUP BY target)"""


@register("e3_overall_metrics_lineitem", f"""WITH {_multi_sql()},
al AS (SELECT target AS "Target", {', '.join(_MCOLS)} FROM mt
       UNION ALL SELECT 'Overall', {', '.join(f'avg({c})' for c in _MCOLS)} FROM mt)
SELECT "Target", {', '.join(f'round_even({c}, 3) AS {c}' for c in _MCOLS)} FROM al""")
def q_e3(spark, sf):
    return metrics.overall_row(_multi_target_metrics(spark, sf), "Target", _MCOLS, digits=3)


@register("a20_target_spread_lineitem", f"""WITH {_multi_sql()}
SELECT {SIG('stddev_pop(rmse)')} AS rmse_sd, {SIG('stddev_pop(mae)')} AS mae_sd FROM mt""")
def q_a20(spark, sf):
    return sig_all(metrics.spread_over_targets(_multi_target_metrics(spark, sf)), 8)
