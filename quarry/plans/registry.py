"""Query registry shared by the catalog modules, plus SQL-side helpers."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.common import LI_KEYS

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ SQL helpers

def SIG(x: str, d: int = 8) -> str:
    return f"CAST(printf('%.{d - 1}e', CAST({x} AS DOUBLE)) AS DOUBLE)"


def HASH(seed, cols: list[str]) -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5(concat_ws('|', '{seed}', {parts}))"


LI_NULLS_SQL = """li_n AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity,
         l_extendedprice, l_discount,
         CASE WHEN l_linenumber = 5 THEN NULL ELSE l_tax END AS l_tax,
         l_returnflag, l_linestatus
  FROM lineitem)"""

LI_KEYS_SQL = ", ".join(LI_KEYS)


