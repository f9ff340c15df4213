"""Column-expression helpers shared by all operators (JVM-side, codegen-friendly)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_FRACTIONAL = (T.FloatType, T.DoubleType)

# Config keys read from the session (spark.conf) by the quantile helpers.


def q(name: str) -> str:
    """Backtick-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, _NUMERIC)


def numeric_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    wanted = set(cols) if cols is not None else None
    return [f.name for f in df.schema.fields
            if is_numeric_type(f.dataType) and (wanted is None or f.name in wanted)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """pandas treats NaN as missing; Spark aggregates propagate NaN. Convert once."""
    targets = {f.name for f in df.schema.fields if isinstance(f.dataType, _FRACTIONAL)}
    if cols is not None:
        targets &= set(cols)
    if not targets:
        return df
    return df.select(*[
        (F.when(F.isnan(col(f.name)), F.lit(None)).otherwise(col(f.name)).alias(f.name)
         if f.name in targets else col(f.name))
        for f in df.schema.fields])


def to_double(c: str | Column) -> Column:
    """Number coercion with failures -> NULL (pandas ``to_numeric(errors='coerce')``)."""
    c = col(c) if isinstance(c, str) else c
    return c.try_cast("double")


def any_true(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def all_true(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def key_hash(seed: int | str, key_cols: list[str]) -> Column:
    """Deterministic, partition-independent row hash: md5 of ``seed|k1|k2...``.

    Keys must be integers or strings (a double's text form differs between
    engines). The same value is produced by ``md5(concat_ws('|', ...))`` in SQL.
    """
    parts = [F.lit(str(seed))] + [col(c).cast("string") for c in key_cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_bucket(h: Column, digits: int = 4) -> Column:
    """Leading hex digits of an md5 as an int bucket (16**digits buckets)."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def round_doubles(df: DataFrame, digits: int = 6, per_col: dict | None = None) -> DataFrame:
    """Round float/double columns (used to compare with other engines)."""
    per_col = per_col or {}
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, _FRACTIONAL):
            out.append(F.round(col(f.name), per_col.get(f.name, digits)).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


def one_row_stats(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """Evaluate several aggregate expressions in a single pass."""
    if not exprs:
        return {}
    row = df.agg(*[e.alias(k) for k, e in exprs.items()]).first()
    return row.asDict()


def bounded_broadcast(df: DataFrame, max_rows: int = 1_000_000):
    """Broadcast hint only after checking the row count (else a shuffle join)."""
    from pyspark.sql import functions as _F
    n = df.count()
    return _F.broadcast(df) if n <= max_rows else df
