"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage, read_table, ship_package  # noqa: F401

# Fixed value: a word is a run of characters other than the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def give_back() -> None:
    """Return freed memory to the system: idle Python workers live on between stages,
    beside the workers of the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def tidy(rows):
    """The rows of a task's generator; then its memory goes back."""
    try:
        yield from rows
    finally:
        give_back()


def tidied(result):
    """A group's result, with its working memory given back."""
    give_back()
    return result


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to write, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def need(df: DataFrame, *names: str) -> None:
    """Raise early and clearly when an input column is missing."""
    have = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def key_of(col: Column) -> Column:
    """A non-null join key: a null and the text 'null' stay apart."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("null"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; keeps array results from
    being recomputed for each element of a higher-order function."""
    return F.element_at(F.transform(F.array(value), body), 1)
