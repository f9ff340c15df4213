"""Shared inputs for the registered queries: tables, derived frames, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.functions.exprs import col
from quarry.session import read_table

LI_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LI_FEATS = ["l_quantity", "l_discount", "l_tax"]
LI_TARGET = "l_extendedprice"
SEED = 42


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def sig(c: Column | str, digits: int = 8) -> Column:
    """Round to ``digits`` significant digits (text round trip, same in SQL as
    ``CAST(printf('%.{d-1}e', x) AS DOUBLE)``); absorbs summation-order noise."""
    c = col(c) if isinstance(c, str) else c
    return F.format_string(f"%.{digits - 1}e", c.cast("double")).try_cast("double")


def sig_all(df: DataFrame, digits: int = 8, skip: tuple = ()) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float") and f.name not in skip:
            out.append(sig(f.name, digits).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


def lineitem_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Driver tables hold no NULLs; make some deterministically (same in SQL)."""
    li = t(spark, sf, "lineitem")
    return li.select(
        *LI_KEYS,
        F.when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount",
        F.when(F.col("l_linenumber") == 5, F.lit(None)).otherwise(F.col("l_tax")).alias("l_tax"),
        "l_returnflag", "l_linestatus")


def price_bin_label(c: Column) -> Column:
    """Text class label that looks like numeric bins."""
    return (F.when(c < 20000, F.lit("<20000"))
            .when(c <= 50000, F.lit("20000-50000"))
            .otherwise(F.lit(">50000")))
