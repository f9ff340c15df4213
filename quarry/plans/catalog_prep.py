"""Registered queries for cleaning (P), transforms (F), outliers (O) and
feature selection (K), each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import clean, outliers, select, split, transform
from quarry.plans.common import (
    LI_KEYS, LI_TARGET, SEED, lineitem_with_nulls, price_bin_label, sig, sig_all, t)
from quarry.plans.registry import HASH, LI_KEYS_SQL, LI_NULLS_SQL, SIG, register

K = LI_KEYS_SQL
NUM4 = ["l_quantity", "l_discount", "l_tax", LI_TARGET]

SPLIT_LI_SQL = f"""sp AS (
  SELECT *, CASE WHEN rk < ceil(0.2::DOUBLE * nrows) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY h) - 1 AS rk, count(*) OVER () AS nrows
        FROM (SELECT *, {HASH(SEED, LI_KEYS)} AS h FROM lineitem)))"""


def _split_li(spark, sf):
    return split.train_test_split(t(spark, sf, "lineitem"), LI_KEYS, 0.2, SEED)


# ------------------------------------------------------------------ P1-P4 missing values

@register("p1_dropna_indicator_lineitem", f"""WITH {LI_NULLS_SQL}
SELECT {K}, l_quantity, l_tax, l_extendedprice FROM li_n
WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL""")
def q_p1(spark, sf):
    df = lineitem_with_nulls(spark, sf).select(*LI_KEYS, "l_quantity", "l_tax", LI_TARGET)
    return clean.drop_missing(df, "indicator", ["l_quantity", "l_tax"], [LI_TARGET])


def _impute_sql(stat: str, source: str = " FROM li_n") -> str:
    return f"""WITH {LI_NULLS_SQL},
st AS (SELECT {stat.format('l_quantity')} AS fq, {stat.format('l_tax')} AS ft{source})
SELECT {K}, {SIG('coalesce(l_quantity, fq)', 12)} AS l_quantity, {SIG('coalesce(l_tax, ft)', 12)} AS l_tax
FROM li_n, st"""


def _impute_q(strategy):
    def q(spark, sf):
        df = lineitem_with_nulls(spark, sf).select(*LI_KEYS, "l_quantity", "l_tax")
        out = clean.impute(df, strategy, "indicator", ["l_quantity", "l_tax"], [])
        return sig_all(out, 12)
    return q


register("p2_impute_mean_lineitem", _impute_sql("avg({})"))(_impute_q("mean"))
register("p3_impute_median_lineitem", _impute_sql("quantile_cont({}, 0.5)"))(_impute_q("median"))
register("p4_impute_const_lineitem", _impute_sql("0.01::DOUBLE", ""))(_impute_q("0.01"))


# ------------------------------------------------------------------ P5-P8 zeros and replacements

@register("p5_drop_zero_all_lineitem", """
SELECT l_discount, l_tax FROM lineitem
WHERE coalesce(l_discount <> 0, TRUE) OR coalesce(l_tax <> 0, TRUE)""")
def q_p5(spark, sf):
    return clean.drop_zero_rows(t(spark, sf, "lineitem").select("l_discount", "l_tax"), "all")


@register("p6_drop_zero_indicator_lineitem", f"""
SELECT {K}, l_discount, l_tax FROM lineitem
WHERE NOT (coalesce(l_discount = 0, FALSE) AND coalesce(l_tax = 0, FALSE))""")
def q_p6(spark, sf):
    df = t(spark, sf, "lineitem").select(*LI_KEYS, "l_discount", "l_tax")
    return clean.drop_zero_rows(df, "indicator", ["l_discount", "l_tax"], [])


@register("p7_replace_values_lineitem", f"""
SELECT {K}, CASE WHEN l_discount IN (0.04, 0.06) THEN 0.0 ELSE l_discount END AS l_discount,
       CASE WHEN l_tax IN (0.04, 0.06) THEN 0.0 ELSE l_tax END AS l_tax FROM lineitem""")
def q_p7(spark, sf):
    df = t(spark, sf, "lineitem").select(*LI_KEYS, "l_discount", "l_tax")
    return clean.replace_values(df, [0.04, 0.06], ["l_discount", "l_tax"])


_LABEL_SQL = ("CASE WHEN l_extendedprice < 20000 THEN '<20000' WHEN l_extendedprice <= 50000 "
              "THEN '20000-50000' ELSE '>50000' END")


@register("p8_replace_patterns_lineitem", f"""
SELECT {K}, CASE WHEN regexp_matches(lbl, '^<') THEN '0' ELSE lbl END AS label
FROM (SELECT {K}, {_LABEL_SQL} AS lbl FROM lineitem)""")
def q_p8(spark, sf):
    df = t(spark, sf, "lineitem").select(*LI_KEYS, price_bin_label(F.col(LI_TARGET)).alias("label"))
    return clean.replace_patterns(df, ["^<"], ["label"])


_TXT_SQL = "CASE WHEN l_linenumber = 1 THEN '>500' ELSE CAST(l_quantity AS VARCHAR) END"


def _txt_frame(spark, sf):
    li = t(spark, sf, "lineitem")
    txt = F.when(F.col("l_linenumber") == 1, F.lit(">500")).otherwise(F.col("l_quantity").cast("string"))
    return li.select(*LI_KEYS, txt.alias("txt"))


@register("p9_coerce_numeric_lineitem", f"""
SELECT {K}, TRY_CAST({_TXT_SQL} AS DOUBLE) AS txt FROM lineitem""")
def q_p9(spark, sf):
    return clean.coerce_numeric(_txt_frame(spark, sf), ["txt"])


@register("p12_non_numeric_target_lineitem", f"""
SELECT count(*) AS n_bad, min(txt) AS example FROM (SELECT {_TXT_SQL} AS txt FROM lineitem)
WHERE txt IS NOT NULL AND TRY_CAST(txt AS DOUBLE) IS NULL""")
def q_p12(spark, sf):
    return clean.non_numeric_sample(_txt_frame(spark, sf), "txt")


@register("p11_model_frame_lineitem", f"""WITH {LI_NULLS_SQL}
SELECT {K}, l_quantity, l_discount, l_tax, l_returnflag, l_extendedprice FROM li_n
WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL
  AND l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL""")
def q_p11(spark, sf):
    return clean.model_frame(lineitem_with_nulls(spark, sf), ["l_quantity", "l_discount", "l_tax"],
                             [LI_TARGET], categoricals=["l_returnflag"], keep=LI_KEYS)


@register("p13_nan_fallback_lineitem", f"""WITH {LI_NULLS_SQL},
st AS (SELECT coalesce(avg(l_quantity), 0) AS mq, coalesce(avg(l_tax), 0) AS mt FROM li_n)
SELECT {K}, {SIG('coalesce(l_quantity, mq)', 12)} AS l_quantity, {SIG('coalesce(l_tax, mt)', 12)} AS l_tax
FROM li_n, st""")
def q_p13(spark, sf):
    df = lineitem_with_nulls(spark, sf).select(*LI_KEYS, "l_quantity", "l_tax")
    out, _ = clean.nan_fallback(df, ["l_quantity", "l_tax"])
    return sig_all(out, 12)


def _infer_sql() -> str:
    rows = []
    for i, c in enumerate(["p_partkey", "p_name", "p_brand", "p_type", "p_size"]):
        if c in ("p_partkey", "p_size"):
            rows.append(f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column, 'numeric' AS role, "
                        f"CAST(NULL AS BIGINT) AS n_distinct")
        else:
            rows.append(f"SELECT CAST({i} AS INTEGER), '{c}', CASE WHEN count(DISTINCT {c}) <= 50 "
                        f"THEN 'categorical' ELSE 'unused' END, count(DISTINCT {c}) FROM part")
    return "\nUNION ALL\n".join(rows)


@register("p16_infer_predictors_part", _infer_sql())
def q_p16(spark, sf):
    return clean.infer_predictors(t(spark, sf, "part"), target="p_retailprice")


@register("p17_regex_group_part", """
SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring$') THEN 'rings'
                       WHEN regexp_matches(p_name, '^blue') THEN 'blue items' ELSE p_name END AS grp
FROM part""")
def q_p17(spark, sf):
    pt = t(spark, sf, "part")
    return pt.select("p_partkey", clean.regex_group_map(F.col("p_name"),
                                                        [("ring$", "rings"), ("^blue", "blue items")]).alias("grp"))


# ------------------------------------------------------------------ F transforms

def _scale_sql(center: str, scale: str) -> str:
    stats = ", ".join(f"{center.format(c)} AS c_{c}, {scale.format(c)} AS s_{c}" for c in NUM4)
    adj = ", ".join(f"c_{c}, CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END AS s_{c}"
                    for c in NUM4)
    outs = ", ".join(f"{SIG(f'({c} - c_{c}) / s_{c}', 10)} AS {c}" for c in NUM4)
    return f"""WITH {SPLIT_LI_SQL},
st0 AS (SELECT {stats} FROM sp WHERE split = 'train'),
st AS (SELECT {adj} FROM st0)
SELECT {K}, split, {outs} FROM sp, st"""


def _scale_q(fitter):
    def q(spark, sf):
        sp = _split_li(spark, sf).select(*LI_KEYS, "split", *NUM4)
        model = fitter(sp.where(F.col("split") == "train"), NUM4)
        return sig_all(model.transform(sp, NUM4), 10)
    return q


register("f3_standard_scale_lineitem", _scale_sql("avg({})", "stddev_pop({})"))(
    _scale_q(transform.fit_standard))
register("f4_robust_scale_lineitem", _scale_sql(
    "quantile_cont({}, 0.5)", "(quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25))"))(
    _scale_q(transform.fit_robust))
register("f6_minmax_scale_lineitem", _scale_sql("min({})", "(max({0}) - min({0}))"))(
    _scale_q(transform.fit_minmax))


@register("f10_winsorize_lineitem", f"""WITH {SPLIT_LI_SQL},
st AS (SELECT {', '.join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in NUM4)}
       FROM sp WHERE split = 'train')
SELECT {K}, split, {', '.join(f"{SIG(f'least(greatest({c}, lo_{c}), hi_{c})', 12)} AS {c}" for c in NUM4)}
FROM sp, st""")
def q_f10(spark, sf):
    sp = _split_li(spark, sf).select(*LI_KEYS, "split", *NUM4)
    return sig_all(transform.fit_winsorizer(sp.where(F.col("split") == "train"), NUM4).transform(sp), 12)


@register("f11_median_imputer_lineitem", f"""WITH {LI_NULLS_SQL},
sp AS (SELECT *, CASE WHEN rk < ceil(0.2::DOUBLE * nrows) THEN 'test' ELSE 'train' END AS split
       FROM (SELECT *, row_number() OVER (ORDER BY h) - 1 AS rk, count(*) OVER () AS nrows
             FROM (SELECT *, {HASH(SEED, LI_KEYS)} AS h FROM li_n))),
st AS (SELECT quantile_cont(l_quantity, 0.5) AS mq, quantile_cont(l_tax, 0.5) AS mt FROM sp WHERE split = 'train')
SELECT {K}, split, {SIG('coalesce(l_quantity, mq)', 12)} AS l_quantity, {SIG('coalesce(l_tax, mt)', 12)} AS l_tax
FROM sp, st""")
def q_f11(spark, sf):
    df = lineitem_with_nulls(spark, sf).select(*LI_KEYS, "l_quantity", "l_tax")
    sp = split.train_test_split(df, LI_KEYS, 0.2, SEED)
    model = transform.fit_imputer(sp.where(F.col("split") == "train"), ["l_quantity", "l_tax"], "median")
    return sig_all(model.transform(sp), 12)


# The market segments present in the driver's customer table.
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("f1_onehot_customer", f"""
WITH h AS (SELECT c_custkey, c_mktsegment, {HASH(SEED, ['c_custkey'])} AS h FROM customer),
r AS (SELECT *, row_number() OVER (ORDER BY h) - 1 AS rk, count(*) OVER () AS n FROM h)
SELECT c_custkey, CASE WHEN rk < ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split,
       {', '.join(f"CASE WHEN c_mktsegment = '{v}' THEN 1.0 ELSE 0.0 END AS c_mktsegment_{v}" for v in _SEGMENTS)}
FROM r""")
def q_f1(spark, sf):
    cu = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    sp = split.train_test_split(cu, ["c_custkey"], 0.2, SEED)
    model = transform.fit_onehot(sp.where(F.col("split") == "train"), ["c_mktsegment"])
    return model.transform(sp)


# ------------------------------------------------------------------ O outliers

def _iqr_bounds_sql() -> str:
    return ", ".join(
        f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
        f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
        for c in NUM4)


_IQR_INLIER = " AND ".join(f"{c} >= lo_{c} AND {c} <= hi_{c}" for c in NUM4)


@register("o1_outliers_iqr_lineitem", f"""WITH {SPLIT_LI_SQL},
b AS (SELECT {_iqr_bounds_sql()} FROM sp WHERE split = 'train')
SELECT {K}, ({_IQR_INLIER}) AS inlier FROM sp, b WHERE split = 'train'""")
def q_o1(spark, sf):
    sp = _split_li(spark, sf)
    train = sp.where(F.col("split") == "train")
    return train.select(*LI_KEYS, outliers.detect(train, NUM4, "IQR").alias("inlier"))


@register("o2_outliers_zscore_lineitem", f"""WITH {SPLIT_LI_SQL},
b AS (SELECT {', '.join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in NUM4)} FROM sp WHERE split = 'train')
SELECT {K}, ({' AND '.join(f"abs(({c} - m_{c}) / s_{c}) < 3" for c in NUM4)}) AS inlier
FROM sp, b WHERE split = 'train'""")
def q_o2(spark, sf):
    sp = _split_li(spark, sf)
    train = sp.where(F.col("split") == "train")
    return train.select(*LI_KEYS, outliers.detect(train, NUM4, "ZScore").alias("inlier"))


@register("o6_outliers_cap_lineitem", f"""WITH {SPLIT_LI_SQL},
b AS (SELECT {_iqr_bounds_sql()} FROM sp WHERE split = 'train')
SELECT {K}, split, {', '.join(f"{SIG(f'least(greatest({c}, lo_{c}), hi_{c})', 12)} AS {c}" for c in NUM4)}
FROM sp, b""")
def q_o6(spark, sf):
    sp = _split_li(spark, sf).select(*LI_KEYS, "split", *NUM4)
    out, _ = outliers.handle(sp, NUM4, "split", "IQR", "cap")
    return sig_all(out, 12)


@register("o7_outlier_info_lineitem", f"""WITH {SPLIT_LI_SQL},
b AS (SELECT {_iqr_bounds_sql()} FROM sp WHERE split = 'train'),
f AS (SELECT ({_IQR_INLIER}) AS inlier FROM sp, b WHERE split = 'train')
SELECT 'IQR' AS method, 'remove' AS action, count(*) FILTER (WHERE NOT inlier) AS outliers,
       count(*) AS original, count(*) - count(*) FILTER (WHERE NOT inlier) AS remaining FROM f""")
def q_o7(spark, sf):
    sp = _split_li(spark, sf).select(*LI_KEYS, "split", *NUM4)
    _, info = outliers.handle(sp, NUM4, "split", "IQR", "remove")
    return info


@register("o5_outliers_remove_lineitem", f"""WITH {SPLIT_LI_SQL},
b AS (SELECT {_iqr_bounds_sql()} FROM sp WHERE split = 'train')
SELECT {K}, split FROM sp, b WHERE split = 'test' OR ({_IQR_INLIER})""")
def q_o5(spark, sf):
    sp = _split_li(spark, sf).select(*LI_KEYS, "split", *NUM4)
    out, _ = outliers.handle(sp, NUM4, "split", "IQR", "remove")
    return out.select(*LI_KEYS, "split")


# ------------------------------------------------------------------ K selection

_KFEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _rank_sql(scores: str) -> str:
    return f"""SELECT feature, {SIG('score', 8)} AS score,
       CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, feature) AS INTEGER) AS rank,
       row_number() OVER (ORDER BY score DESC NULLS LAST, feature) <= 2 AS selected
FROM ({scores})"""


def _fr_sql() -> str:
    parts = []
    for f in _KFEATS:
        r = f"(covar_pop({f}, l_extendedprice) / (stddev_pop({f}) * stddev_pop(l_extendedprice)))"
        parts.append(f"SELECT '{f}' AS feature, {r} * {r} / (1 - {r} * {r}) * (count(*) - 2) AS score FROM lineitem")
    return _rank_sql("\nUNION ALL\n".join(parts))


@register("k1_kbest_f_regression_lineitem", _fr_sql())
def q_k1(spark, sf):
    out = select.f_regression(t(spark, sf, "lineitem"), _KFEATS, LI_TARGET, k=2)
    return out.select("feature", sig("score", 8).alias("score"), "rank", "selected")


def _fc_sql() -> str:
    parts = []
    for f in _KFEATS:
        parts.append(f"""SELECT '{f}' AS feature,
  (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS score
FROM (SELECT n, m, v, sum(n * m) OVER () / sum(n) OVER () AS gm
      FROM (SELECT count(*) AS n, avg({f}) AS m, var_pop({f}) AS v FROM lineitem GROUP BY l_returnflag))""")
    return _rank_sql("\nUNION ALL\n".join(parts))


@register("k2_kbest_anova_lineitem", _fc_sql())
def q_k2(spark, sf):
    out = select.f_classif(t(spark, sf, "lineitem"), _KFEATS, "l_returnflag", k=2)
    return out.select("feature", sig("score", 8).alias("score"), "rank", "selected")


@register("o3_isolation_forest_lineitem")
def q_o3(spark, sf):
    sp = _split_li(spark, sf)
    train = sp.where(F.col("split") == "train")
    return train.select(*LI_KEYS, outliers.detect(train, NUM4, "IsolationForest", LI_KEYS).alias("inlier"))
