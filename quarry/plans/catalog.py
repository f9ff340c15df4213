"""Registered queries: each reads the driver tables and runs one inventory
operator end to end. ``ORACLE`` holds the equivalent DuckDB SQL (same column
names; floats rounded the same way on both sides)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarry.functions.exprs import bounded_broadcast
from quarry.functions.labels import label_order
from quarry.operators import clean, correlate, profile, split
from quarry.plans.common import (
    LI_FEATS, LI_KEYS, LI_TARGET, SEED, lineitem_with_nulls, price_bin_label, sig, sig_all, t)

from quarry.plans.registry import HASH, LI_KEYS_SQL, LI_NULLS_SQL, ORACLE, REGISTRY, SIG, register  # noqa: F401


# ------------------------------------------------------------------ S4 profile

@register("s4_profile_lineitem", f"""
SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns, count(*) * 11 AS n_cells,
       'l_orderkey' AS first_column, 'l_shipdate' AS last_column,
       CASE WHEN count(*) * 11 >= 1000000 THEN 'large'
            WHEN count(*) * 11 >= 500000 THEN 'moderate' ELSE 'small' END AS size_note
FROM lineitem""")
def q_profile(spark, sf):
    return profile.dataset_profile(t(spark, sf, "lineitem"))


# ------------------------------------------------------------------ A1 describe

_DESC_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS column, count({c}) AS n, {SIG(f'min({c})', 10)} AS min, "
            f"{SIG(f'max({c})', 10)} AS max, {SIG(f'avg({c})', 10)} AS mean, "
            f"{SIG(f'CASE WHEN count({c}) > 1 THEN stddev_samp({c}) END', 10)} AS sd, "
            f"{SIG(f'quantile_cont({c}, 0.25)', 10)} AS p25, {SIG(f'quantile_cont({c}, 0.5)', 10)} AS p50, "
            f"{SIG(f'quantile_cont({c}, 0.75)', 10)} AS p75, {SIG(f'quantile_cont({c}, 1.0)', 10)} AS p100 "
            f"FROM {table}")
    return "\nUNION ALL\n".join(parts)


@register("a1_describe_lineitem", _describe_sql("lineitem", _DESC_COLS))
def q_describe(spark, sf):
    return sig_all(profile.describe(t(spark, sf, "lineitem"), _DESC_COLS), 10)


# ------------------------------------------------------------------ A3 categorical detection

def _detect_cat_sql() -> str:
    kinds = [("p_partkey", "integer"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"),
             ("p_size", "integer"), ("p_retailprice", "numeric")]
    parts = []
    for c, k in kinds:
        cat = ("TRUE" if k == "text" else
               f"(count(DISTINCT {c}) <= 50 AND min({c}) >= 0)" if k == "integer" else "FALSE")
        parts.append(f"SELECT '{c}' AS column, '{k}' AS kind, count(DISTINCT {c}) AS n_distinct, "
                     f"{cat} AS is_categorical FROM part")
    return "\nUNION ALL\n".join(parts)


@register("a3_detect_categorical_part", _detect_cat_sql())
def q_detect_cat(spark, sf):
    return profile.detect_categorical(t(spark, sf, "part"))


# ------------------------------------------------------------------ A4 blanks / zeros

_BZ_COLS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag"]


def _bz_sql() -> str:
    parts = []
    for c in _BZ_COLS:
        if c == "l_returnflag":
            parts.append(f"SELECT '{c}' AS column, bool_or({c} IS NULL) AS has_blank, FALSE AS has_zero FROM li_n")
        else:
            parts.append(f"SELECT '{c}' AS column, bool_or({c} IS NULL OR isnan({c})) AS has_blank, "
                         f"coalesce(bool_or({c} = 0), FALSE) AS has_zero FROM li_n")
    return f"WITH {LI_NULLS_SQL}\n" + "\nUNION ALL\n".join(parts)


@register("a4_blanks_zeros_lineitem", _bz_sql())
def q_blanks(spark, sf):
    return profile.detect_blanks_zeros(lineitem_with_nulls(spark, sf), _BZ_COLS)


# ------------------------------------------------------------------ A5/A6 correlations

_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pearson_sql(table: str, cols: list[str]) -> str:
    parts = []
    for a in cols:
        for b in cols:
            r = (f"covar_pop({a}, {b}) / (stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * "
                 f"stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END))")
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                         f"round(least(greatest({r}, -1.0), 1.0), 9) AS r FROM {table}")
    return "\nUNION ALL\n".join(parts)


@register("a5_pearson_lineitem_nulls", f"WITH {LI_NULLS_SQL}\n" + _pearson_sql("li_n", _CORR_COLS))
def q_pearson(spark, sf):
    out = correlate.pearson(lineitem_with_nulls(spark, sf), _CORR_COLS)
    return out.select("col_a", "col_b", F.round("r", 9).alias("r"))


def _spearman_sql() -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}"
        for c in _CORR_COLS)
    return f"WITH rk AS (SELECT {ranks} FROM lineitem)\n" + _pearson_sql("rk", _CORR_COLS)


@register("a6_spearman_lineitem", _spearman_sql())
def q_spearman(spark, sf):
    out = correlate.spearman(t(spark, sf, "lineitem"), _CORR_COLS)
    return out.select("col_a", "col_b", F.round("r", 9).alias("r"))


# ------------------------------------------------------------------ A10-A14, A21, A24

@register("a11_histogram_lineitem", f"""
WITH mm AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem),
b AS (SELECT CAST(least(greatest(floor((l_extendedprice - mn) * 20.0 / (mx - mn)), 0), 19) AS INTEGER) AS bin
      FROM lineitem, mm),
c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20))
SELECT g.bin, {SIG('mn + g.bin * ((mx - mn) / 20)', 12)} AS lo,
       {SIG('mn + (g.bin + 1) * ((mx - mn) / 20)', 12)} AS hi,
       coalesce(c.count, 0) AS count
FROM g CROSS JOIN mm LEFT JOIN c ON g.bin = c.bin""")
def q_hist(spark, sf):
    return sig_all(profile.histogram(t(spark, sf, "lineitem"), LI_TARGET, 20), 12)


@register("a12_histogram2d_lineitem", """
WITH mm AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh,
                   min(l_extendedprice) AS yl, max(l_extendedprice) AS yh FROM lineitem)
SELECT CAST(least(greatest(floor((l_quantity - xl) * 40.0 / (xh - xl)), 0), 39) AS INTEGER) AS bin_x,
       CAST(least(greatest(floor((l_extendedprice - yl) * 40.0 / (yh - yl)), 0), 39) AS INTEGER) AS bin_y,
       count(*) AS count
FROM lineitem, mm GROUP BY 1, 2""")
def q_hist2d(spark, sf):
    return profile.histogram2d(t(spark, sf, "lineitem"), "l_quantity", LI_TARGET, 40)


@register("a10_value_counts_orders", """
SELECT o_orderpriority AS value, count(*) AS count FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def q_value_counts(spark, sf):
    return profile.value_counts(t(spark, sf, "orders"), "o_orderpriority")


@register("a14_preview_orders", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL
ORDER BY o_orderkey LIMIT 200""")
def q_preview(spark, sf):
    return profile.preview(t(spark, sf, "orders"), "o_totalprice", ["o_orderkey"], 200).select(
        "o_orderkey", "o_totalprice")


@register("a21_mean_sd_orders", f"""
SELECT 'o_totalprice' AS column, {SIG('avg(o_totalprice)', 10)} AS mean,
       {SIG('stddev_pop(o_totalprice)', 10)} AS sd_pop FROM orders
UNION ALL
SELECT 'o_custkey', {SIG('avg(o_custkey)', 10)}, {SIG('stddev_pop(o_custkey)', 10)} FROM orders""")
def q_mean_sd(spark, sf):
    return sig_all(profile.mean_sd(t(spark, sf, "orders"), ["o_totalprice", "o_custkey"]), 10)


@register("a24_quantile_edges_orders", "\nUNION ALL\n".join(
    f"SELECT {j} AS edge, {j / 4}::DOUBLE AS prob, {SIG(f'quantile_cont(o_totalprice, {j / 4})', 12)} AS value "
    f"FROM orders" for j in range(5)))
def q_qedges(spark, sf):
    return sig_all(profile.quantile_boundaries(t(spark, sf, "orders"), "o_totalprice", 4), 12)


# ------------------------------------------------------------------ B9-B14 splits

def _split_sql(table: str, keys: list[str], seed=SEED, size=0.2) -> str:
    ks = ", ".join(keys)
    return f"""
WITH h AS (SELECT {ks}, {HASH(seed, keys)} AS h FROM {table}),
r AS (SELECT *, row_number() OVER (ORDER BY h) - 1 AS rk, count(*) OVER () AS n FROM h)
SELECT {ks}, CASE WHEN rk < ceil({size}::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM r"""


@register("b9_split_lineitem", _split_sql("lineitem", LI_KEYS))
def q_split(spark, sf):
    return split.train_test_split(t(spark, sf, "lineitem").select(*LI_KEYS), LI_KEYS, 0.2, SEED)


@register("b10_split_stratified_lineitem", f"""
WITH h AS (SELECT {LI_KEYS_SQL}, l_returnflag AS s, {HASH(SEED, LI_KEYS)} AS h FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h) - 1 AS rk FROM h),
c AS (SELECT s, count(*) AS cnt FROM h GROUP BY s),
tot AS (SELECT sum(cnt) AS n, CAST(ceil(0.2::DOUBLE * sum(cnt)) AS BIGINT) AS nt FROM c),
a AS (SELECT s, (nt * cnt) // n AS base, (nt * cnt) % n AS rem, nt FROM c, tot),
b AS (SELECT s, base, row_number() OVER (ORDER BY rem DESC, s ASC) AS pos,
             nt - sum(base) OVER () AS lft FROM a),
al AS (SELECT s, base + CASE WHEN pos <= lft THEN 1 ELSE 0 END AS alloc FROM b)
SELECT {LI_KEYS_SQL}, l_returnflag, CASE WHEN rk < alloc THEN 'test' ELSE 'train' END AS split
FROM r JOIN al USING (s) JOIN lineitem USING ({LI_KEYS_SQL})""")
def q_split_strat(spark, sf):
    li = t(spark, sf, "lineitem").select(*LI_KEYS, "l_returnflag")
    return split.train_test_split(li, LI_KEYS, 0.2, SEED, stratify="l_returnflag")


def _kfold_sql(table: str, keys: list[str], k: int, seed, extra: str = "") -> str:
    ks = ", ".join(keys)
    return f"""
WITH h AS (SELECT {ks}, {HASH(seed, keys)} AS h FROM {table}),
r AS (SELECT *, row_number() OVER (ORDER BY h) - 1 AS rk, count(*) OVER () AS n FROM h),
z AS (SELECT *, n // {k} AS q, n % {k} AS m FROM r)
SELECT {ks}, CAST(CASE WHEN rk < m * (q + 1) THEN rk // (q + 1) ELSE m + (rk - m * (q + 1)) // q END
              AS INTEGER) AS fold{extra} FROM z"""


@register("b11_kfold_lineitem", _kfold_sql("lineitem", LI_KEYS, 5, SEED))
def q_kfold(spark, sf):
    return split.kfold(t(spark, sf, "lineitem").select(*LI_KEYS), LI_KEYS, 5, SEED).withColumn(
        "fold", F.col("fold").cast("int"))


def _strat_kfold_sql(k: int = 5) -> str:
    def F_(x, f):
        return f"(({x}) // {k}) * {f} + least(({x}) % {k}, {f})"
    terms = " + ".join(
        f"CASE WHEN ({F_('off + cnt', f)}) - ({F_('off', f)}) <= rk THEN 1 ELSE 0 END" for f in range(1, k))
    return f"""
WITH h AS (SELECT {LI_KEYS_SQL}, l_returnflag AS s, {HASH(SEED, LI_KEYS)} AS h FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h) - 1 AS rk FROM h),
c AS (SELECT s, count(*) AS cnt FROM h GROUP BY s),
o AS (SELECT s, cnt, coalesce(sum(cnt) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             AS off FROM c)
SELECT {LI_KEYS_SQL}, r.s AS l_returnflag, CAST({terms} AS INTEGER) AS fold FROM r JOIN o USING (s)"""


@register("b12_stratified_kfold_lineitem", _strat_kfold_sql(5))
def q_strat_kfold(spark, sf):
    li = t(spark, sf, "lineitem").select(*LI_KEYS, "l_returnflag")
    return split.kfold(li, LI_KEYS, 5, SEED, stratify="l_returnflag").withColumn(
        "fold", F.col("fold").cast("int"))


@register("b13_repeated_kfold_orders", "\nUNION ALL\n".join(
    f"SELECT * FROM ({_kfold_sql('orders', ['o_orderkey'], 5, SEED + r, f', CAST({r} AS INTEGER) AS repeat')})"
    for r in range(2)))
def q_rep_kfold(spark, sf):
    out = split.repeated_kfold(t(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 5, 2, SEED)
    return out.withColumn("fold", F.col("fold").cast("int"))


@register("b14_shuffle_split_orders", "\nUNION ALL\n".join(
    f"SELECT *, CAST({i} AS INTEGER) AS split_id FROM ({_split_sql('orders', ['o_orderkey'], SEED + i)})"
    for i in range(3)))
def q_shuffle(spark, sf):
    return split.shuffle_split(t(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 3, 0.2, SEED)


# ------------------------------------------------------------------ B1-B3 strata

@register("b1_quantile_strata_lineitem", """
WITH e AS (SELECT quantile_cont(l_extendedprice, 0.2) AS e1, quantile_cont(l_extendedprice, 0.4) AS e2,
                  quantile_cont(l_extendedprice, 0.6) AS e3, quantile_cont(l_extendedprice, 0.8) AS e4
           FROM lineitem)
SELECT 5 AS q, CAST((l_extendedprice > e1)::INT + (l_extendedprice > e2)::INT + (l_extendedprice > e3)::INT
                    + (l_extendedprice > e4)::INT AS INTEGER) AS bin, count(*) AS n
FROM lineitem, e GROUP BY 1, 2""")
def q_qstrata(spark, sf):
    li = t(spark, sf, "lineitem")
    _, qq, counts = split.quantile_strata(li, LI_TARGET, 5, 2, 0.2)
    return spark.createDataFrame([(qq, int(b), int(n)) for b, n in counts.items()], "q int, bin int, n long")


@register("b2_fixed_bins_lineitem", """
SELECT CAST((l_extendedprice > 20000)::INT + (l_extendedprice > 50000)::INT AS INTEGER) AS bin, count(*) AS n
FROM lineitem GROUP BY 1""")
def q_fixed_bins(spark, sf):
    li = t(spark, sf, "lineitem")
    df, counts = split.fixed_bin_strata(li, LI_TARGET, [float("-inf"), 20000, 50000, float("inf")])
    return df.groupBy(F.col("__stratum").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("b3_class_strata_lineitem", """
SELECT l_returnflag AS stratum, count(*) AS count, (count(*) >= 2 AND count(*) * 0.2 >= 1) AS ok
FROM lineitem GROUP BY 1""")
def q_class_strata(spark, sf):
    return split.strata_counts(t(spark, sf, "lineitem"), "l_returnflag", 0.2)


# ------------------------------------------------------------------ B7/B8 label order

_GT = r"^>\s*([-\d.eE+]+)\s*$"
_LT = r"^<\s*([-\d.eE+]+)\s*$"
_RG = r"^([-\d.eE+]+)\s*[-–]\s*([-\d.eE+]+)\s*$"


def _label_keys_sql(x: str) -> str:
    s = f"trim({x})"
    plain = f"TRY_CAST(replace({s}, ',', '') AS DOUBLE)"
    gt = f"CASE WHEN regexp_matches({s}, '{_GT}') THEN TRY_CAST(regexp_extract({s}, '{_GT}', 1) AS DOUBLE) END"
    lt = f"CASE WHEN regexp_matches({s}, '{_LT}') THEN TRY_CAST(regexp_extract({s}, '{_LT}', 1) AS DOUBLE) END"
    ra = f"CASE WHEN regexp_matches({s}, '{_RG}') THEN TRY_CAST(regexp_extract({s}, '{_RG}', 1) AS DOUBLE) END"
    rb = f"CASE WHEN regexp_matches({s}, '{_RG}') THEN TRY_CAST(regexp_extract({s}, '{_RG}', 2) AS DOUBLE) END"
    return f"""SELECT {x} AS label, {plain} AS pl, {gt} AS gt, {lt} AS lt, {ra} AS ra, {rb} AS rb, {s} AS s"""


def _label_order_sql(src: str) -> str:
    return f"""
WITH d AS ({src}),
k AS ({_label_keys_sql('label')} FROM d),
kk AS (SELECT label,
  CASE WHEN pl IS NOT NULL THEN pl WHEN gt IS NOT NULL THEN gt WHEN lt IS NOT NULL THEN CAST('-inf' AS DOUBLE)
       WHEN ra IS NOT NULL AND rb IS NOT NULL THEN ra ELSE CAST('inf' AS DOUBLE) END AS k1,
  CASE WHEN pl IS NOT NULL THEN pl WHEN gt IS NOT NULL THEN CAST('inf' AS DOUBLE) WHEN lt IS NOT NULL THEN lt
       WHEN ra IS NOT NULL AND rb IS NOT NULL THEN rb ELSE CAST('inf' AS DOUBLE) END AS k2,
  CASE WHEN pl IS NOT NULL OR gt IS NOT NULL OR lt IS NOT NULL OR (ra IS NOT NULL AND rb IS NOT NULL)
       THEN '' ELSE s END AS k3
  FROM k)
SELECT label, row_number() OVER (ORDER BY k1, k2, k3, label) - 1 AS label_order FROM kk"""


_MIXED_LABELS_SQL = """
SELECT DISTINCT label FROM (
  SELECT CASE WHEN l_extendedprice < 20000 THEN '<20000' WHEN l_extendedprice <= 50000 THEN '20000-50000'
              ELSE '>50000' END AS label FROM lineitem
  UNION ALL SELECT l_returnflag FROM lineitem
  UNION ALL SELECT o_orderpriority FROM orders
  UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part) u WHERE label IS NOT NULL"""


@register("b7_label_order_mixed", _label_order_sql(_MIXED_LABELS_SQL))
def q_label_order(spark, sf):
    li, od, pt = t(spark, sf, "lineitem"), t(spark, sf, "orders"), t(spark, sf, "part")
    labels = (li.select(price_bin_label(F.col(LI_TARGET)).alias("label"))
              .unionByName(li.select(F.col("l_returnflag").alias("label")))
              .unionByName(od.select(F.col("o_orderpriority").alias("label")))
              .unionByName(pt.select(F.col("p_size").cast("string").alias("label"))))
    return label_order(labels, "label").withColumn("label_order", F.col("label_order").cast("long"))


@register("b8_ordinal_codes_orders", f"""
WITH lo AS ({_label_order_sql('SELECT DISTINCT o_orderpriority AS label FROM orders')})
SELECT o_orderkey, label_order AS code FROM orders JOIN lo ON o_orderpriority = label""")
def q_ordinal(spark, sf):
    od = t(spark, sf, "orders")
    codes = label_order(od, "o_orderpriority")  # one row per class
    return (od.join(bounded_broadcast(codes), od.o_orderpriority == codes.label)
            .select("o_orderkey", F.col("label_order").cast("long").alias("code")))


# ------------------------------------------------------------------ A7 Kendall tau-b

_KEN_COLS = ["p_size", "p_retailprice", "p_partkey"]


def _kendall_sql() -> str:
    parts = [f"SELECT '{c}' AS col_a, '{c}' AS col_b, CASE WHEN count(DISTINCT {c}) > 1 THEN 1.0 END AS r FROM part"
             for c in _KEN_COLS]
    for i, a in enumerate(_KEN_COLS):
        for b in _KEN_COLS[i + 1:]:
            tau = f"""(SELECT round(least(greatest(s / sqrt((n0 - n1) * (n0 - n2)), -1.0), 1.0), 9) FROM
  (SELECT CAST(sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b})) AS DOUBLE) AS s
   FROM part p JOIN part q ON p.p_partkey < q.p_partkey),
  (SELECT count(*) * (count(*) - 1) / 2.0 AS n0 FROM part),
  (SELECT sum(c * (c - 1) / 2.0) AS n1 FROM (SELECT count(*) AS c FROM part GROUP BY {a})),
  (SELECT sum(c * (c - 1) / 2.0) AS n2 FROM (SELECT count(*) AS c FROM part GROUP BY {b})))"""
            parts.append(f"SELECT '{a}', '{b}', {tau}")
            parts.append(f"SELECT '{b}', '{a}', {tau}")
    return "\nUNION ALL\n".join(parts)


@register("a7_kendall_part", _kendall_sql())
def q_kendall(spark, sf):
    out = correlate.kendall(t(spark, sf, "part"), _KEN_COLS)
    return out.select("col_a", "col_b", F.round("r", 9).alias("r"))


# ------------------------------------------------------------------ A8 all methods, A23 density curve

def _spearman_sql_for(table: str, cols: list[str]) -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in cols)
    return f"SELECT * FROM (WITH rk AS (SELECT {ranks} FROM {table})\n{_pearson_sql('rk', cols)})"


@register("a8_correlations_part", "\nUNION ALL\n".join([
    f"SELECT *, 'pearson' AS method FROM ({_pearson_sql('part', _KEN_COLS)})",
    f"SELECT *, 'spearman' AS method FROM ({_spearman_sql_for('part', _KEN_COLS)})",
    f"SELECT *, 'kendall' AS method FROM ({_kendall_sql()})"]))
def q_a8(spark, sf):
    out = correlate.correlations(t(spark, sf, "part"), _KEN_COLS)
    return out.select("col_a", "col_b", F.round("r", 9).alias("r"), "method")


@register("a23_kde_lineitem", f"""
WITH xs AS (SELECT l_extendedprice AS x FROM lineitem),
st AS (SELECT count(x) AS n, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi FROM xs),
bw AS (SELECT *, sd * pow(n, -1.0 / 5) AS bw FROM st),
b AS (SELECT CAST(least(greatest(floor((x - lo) * 4096.0 / (hi - lo)), 0), 4095) AS INTEGER) AS b,
             count(*) AS nb, avg(x) AS m FROM xs, bw GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS point,
             CASE WHEN range = 199 THEN hi ELSE range * ((hi - lo) / 199) + lo END AS gx FROM range(200), bw)
SELECT point, {SIG('gx', 10)} AS x,
       {SIG('sum(nb * exp(-0.5 * ((gx - m) / bw) * ((gx - m) / bw))) / (n * bw * sqrt(2 * pi()))')} AS density
FROM g, b, bw GROUP BY point, gx, n, bw""")
def q_a23(spark, sf):
    out = profile.kde_curve(t(spark, sf, "lineitem"), LI_TARGET, 200, fine_bins=4096)  # as its SQL has it
    return out.select("point", sig("x", 10).alias("x"), sig("density", 8).alias("density"))


@register("a23_kde_rows_lineitem", f"""
WITH xs AS (SELECT l_extendedprice AS x FROM lineitem),
st AS (SELECT count(x) AS n, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi FROM xs),
bw AS (SELECT *, sd * pow(n, -1.0 / 5) AS bw FROM st),
g AS (SELECT CAST(range AS INTEGER) AS point,
             CASE WHEN range = 199 THEN hi ELSE range * ((hi - lo) / 199) + lo END AS gx FROM range(200), bw)
SELECT point, {SIG('gx', 10)} AS x,
       {SIG('sum(exp(-0.5 * ((gx - x) / bw) * ((gx - x) / bw))) / (n * bw * sqrt(2 * pi()))')} AS density
FROM g, xs, bw GROUP BY point, gx, n, bw""")
def q_a23_rows(spark, sf):
    out = profile.kde_curve(t(spark, sf, "lineitem"), LI_TARGET, 200)
    return out.select("point", sig("x", 10).alias("x"), sig("density", 8).alias("density"))
