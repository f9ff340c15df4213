"""Registered queries of the strata fallbacks (B4, B6) and of row and column
selection (P10, P14), each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import clean, split
from quarry.plans.common import LI_KEYS, lineitem_with_nulls, t
from quarry.plans.registry import LI_KEYS_SQL, LI_NULLS_SQL, register


@register("b4_rank_strata_lineitem", """
WITH r AS (SELECT (rank() OVER (ORDER BY l_quantity)
                   + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE)
                  / (count(*) OVER () + 1e-9::DOUBLE) AS rq FROM lineitem),
e AS (SELECT quantile_cont(rq, 0.2) AS e1, quantile_cont(rq, 0.4) AS e2,
             quantile_cont(rq, 0.6) AS e3, quantile_cont(rq, 0.8) AS e4 FROM r)
SELECT 5 AS q, CAST((rq > e1)::INT + (rq > e2)::INT + (rq > e3)::INT + (rq > e4)::INT AS INTEGER) AS bin, count(*) AS n
FROM r, e GROUP BY 1, 2""")
def q_b4(spark, sf):
    _, q, counts = split.rank_quantile_strata(t(spark, sf, "lineitem"), "l_quantity", 5, 2, 0.2)
    return spark.createDataFrame([(q, int(b), int(n)) for b, n in counts.items()], "q int, bin int, n long")


@register("b6_robustness_strata_lineitem", f"""
WITH e AS (SELECT quantile_cont(l_extendedprice, 0.2) AS e1, quantile_cont(l_extendedprice, 0.4) AS e2,
                  quantile_cont(l_extendedprice, 0.6) AS e3, quantile_cont(l_extendedprice, 0.8) AS e4
           FROM lineitem)
SELECT {LI_KEYS_SQL}, CAST((l_extendedprice > e1)::INT + (l_extendedprice > e2)::INT + (l_extendedprice > e3)::INT
                           + (l_extendedprice > e4)::INT AS INTEGER) AS stratum
FROM lineitem, e""")
def q_b6(spark, sf):
    out, _, _ = split.robustness_strata(t(spark, sf, "lineitem"), "l_extendedprice")
    return out.select(*LI_KEYS, F.col("__stratum").cast("int").alias("stratum"))


@register("p10_complete_rows_lineitem", f"""WITH {LI_NULLS_SQL}
SELECT {LI_KEYS_SQL}, l_quantity FROM li_n
WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL AND l_extendedprice IS NOT NULL""")
def q_p10(spark, sf):
    rows = clean.complete_rows(lineitem_with_nulls(spark, sf), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])
    return rows.select(*LI_KEYS, "l_quantity")


@register("p14_numeric_only_orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_p14(spark, sf):
    return clean.numeric_only(t(spark, sf, "orders"))
