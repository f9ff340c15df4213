"""Row drops, imputation, zero handling and coercion.

``preprocess`` keeps the reference order: missing -> zero-row drop -> value
replace -> pattern replace. Statistics for imputation come from one
aggregation pass and are applied with ``coalesce`` (no collect of rows).
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.exprs import (
    all_true, any_true, col, nan_to_null, numeric_columns, to_double)
from quarry.functions.quantiles import column_quantiles

SCOPES = ("all", "indicator", "target", "indicatorAndTarget")


def scope_columns(df: DataFrame, scope: str, indicators: Sequence[str] | None,
                  targets: Sequence[str] | None) -> list[str] | None:
    """Columns a cleaning scope refers to; None = scope not applicable."""
    indicators, targets = list(indicators or []), list(targets or [])
    if scope == "all":
        return list(df.columns)
    if scope == "indicator":
        return indicators
    if scope == "target":
        return targets if targets else None
    if scope == "indicatorAndTarget":
        return indicators + targets if targets else None
    return None


def drop_missing(df: DataFrame, scope: str = "all", indicators=None, targets=None) -> DataFrame:
    """Drop rows with any NULL in the scope's columns."""
    cols = scope_columns(df, scope, indicators, targets)
    if cols is None:
        return df
    return df.na.drop(how="any", subset=cols) if cols else df


def impute(df: DataFrame, strategy, scope: str = "all", indicators=None, targets=None) -> DataFrame:
    """Fill NULLs of numeric scope columns with mean, median or a constant."""
    cols = scope_columns(df, scope, indicators, targets)
    if cols is None:
        return df
    num = numeric_columns(df, cols)
    if not num:
        return df
    if isinstance(strategy, str) and strategy not in ("mean", "median"):
        strategy = float(strategy)  # "0" / "0.01" arrive as text
    if strategy == "mean":
        row = df.agg(*[F.avg(col(c)).alias(c) for c in num]).first()
        fills = {c: row[c] for c in num}
    elif strategy == "median":
        qs = column_quantiles(df, num, [0.5])
        fills = {c: qs[c][0] for c in num}
    else:
        fills = {c: float(strategy) for c in num}
    return _fill(df, fills)


def _fill(df: DataFrame, fills: dict) -> DataFrame:
    out = []
    for f in df.schema.fields:
        v = fills.get(f.name)
        if v is None:
            out.append(col(f.name))
        else:
            out.append(F.coalesce(col(f.name), F.lit(v).cast(f.dataType)).alias(f.name)
                       if f.dataType.typeName() in ("double", "float")
                       else F.coalesce(col(f.name).cast("double"), F.lit(float(v))).alias(f.name))
    return df.select(*out)


def drop_zero_rows(df: DataFrame, scope: str = "all", indicators=None, targets=None) -> DataFrame:
    """P5/P6.

    scope 'all': keep rows where ANY column differs from 0 (NULL and text count
    as non-zero). Other scopes: drop rows whose scope columns are ALL exactly 0
    (a NULL is not 0).
    """
    if scope == "all":
        conds = []
        for f in df.schema.fields:
            if f.dataType.typeName() in ("string", "boolean"):
                conds.append(F.lit(True) if f.dataType.typeName() == "string"
                             else F.coalesce(col(f.name).cast("int") != 0, F.lit(True)))
            else:
                conds.append(F.coalesce(col(f.name) != 0, F.lit(True)))
        return df.where(any_true(conds))
    cols = scope_columns(df, scope, indicators, targets)
    if not cols:
        return df
    types = dict((f.name, f.dataType.typeName()) for f in df.schema.fields)
    zero = [F.coalesce(col(c) == 0, F.lit(False)) if types[c] != "string" else F.lit(False)
            for c in cols]
    return df.where(~all_true(zero))


def replace_values(df: DataFrame, values: Sequence, cols: Sequence[str] | None = None) -> DataFrame:
    """Exact values -> 0 in every (or the given) column."""
    if not values:
        return df
    cols = set(cols or df.columns)
    out = []
    for f in df.schema.fields:
        if f.name not in cols:
            out.append(col(f.name))
            continue
        if f.dataType.typeName() == "string":
            vals = [str(v) for v in values]
            out.append(F.when(col(f.name).isin(vals), F.lit("0")).otherwise(col(f.name)).alias(f.name))
        else:
            vals = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
            if not vals:
                out.append(col(f.name))
            else:
                out.append(F.when(col(f.name).isin(vals), F.lit(0).cast(f.dataType))
                           .otherwise(col(f.name)).alias(f.name))
    return df.select(*out)


def replace_patterns(df: DataFrame, patterns: Sequence[str | Callable[[Column], Column]],
                     cols: Sequence[str] | None = None) -> DataFrame:
    """Value -> 0 where any pattern matches.

    A pattern is a Java regex applied to the value's text (``'^<'`` = starts
    with '<') or a function Column -> boolean Column.
    """
    if not patterns:
        return df
    cols = set(cols or df.columns)
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name not in cols:
            out.append(c)
            continue
        hits = [(p(c) if callable(p) else c.cast("string").rlike(p)) for p in patterns]
        hit = F.coalesce(any_true(hits), F.lit(False))
        zero = F.lit("0") if f.dataType.typeName() == "string" else F.lit(0).cast(f.dataType)
        out.append(F.when(hit, zero).otherwise(c).alias(f.name))
    return df.select(*out)


def preprocess(df: DataFrame, targets=None, indicators=None, drop_missing_scope: str = "all",
               impute_strategy=None, drop_zero: str | None = "all", zero_values=None,
               zero_patterns=None) -> DataFrame:
    """The reference's cleaning step, in its fixed order.

    ``impute_strategy`` None or 'none' drops rows in scope; otherwise fills.
    """
    out = nan_to_null(df)
    if impute_strategy is None or impute_strategy == "none":
        out = drop_missing(out, drop_missing_scope, indicators, targets)
    else:
        out = impute(out, impute_strategy, drop_missing_scope, indicators, targets)
    if drop_zero:
        out = drop_zero_rows(out, drop_zero, indicators, targets)
    out = replace_values(out, zero_values or [])
    out = replace_patterns(out, zero_patterns or [])
    return out


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text -> double, failures -> NULL."""
    cols = set(cols)
    return df.select(*[(to_double(f.name).alias(f.name) if f.name in cols else col(f.name))
                       for f in df.schema.fields])


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows with every listed column present."""
    return df.where(all_true([col(c).isNotNull() for c in cols])) if cols else df


def model_frame(df: DataFrame, indicators: Sequence[str], targets: Sequence[str],
                categoricals: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Numeric indicators + chosen categoricals + targets, NULL rows dropped."""
    num = numeric_columns(df, indicators)
    cats = [c for c in categoricals if c in df.columns and c not in num]
    use = list(dict.fromkeys(list(keep) + num + cats + list(targets)))
    return df.select(*[col(c) for c in use]).na.drop(how="any", subset=num + cats + list(targets))


def non_numeric_sample(df: DataFrame, target: str) -> DataFrame:
    """Count and smallest example of values that are present but not numbers."""
    bad = df.where(col(target).isNotNull() & to_double(target).isNull())
    return bad.agg(F.count(F.lit(1)).alias("n_bad"),
                   F.min(col(target).cast("string")).alias("example"))


def require_numeric_target(df: DataFrame, target: str) -> None:
    """P12 guard: raise quoting a sample bad value."""
    if df.schema[target].dataType.typeName() not in ("string",):
        return
    row = non_numeric_sample(df, target).first()
    if row["n_bad"]:
        raise ValueError(f"target {target!r} must be numeric; found value {row['example']!r}")


def nan_fallback(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict]:
    """Numeric NULL/NaN -> column mean (0 when the column is all NULL),
    +-inf -> 0; non-numeric columns that still hold NULLs are dropped.
    Returns the frame and per-column counts of filled cells."""
    num = numeric_columns(df, cols)
    clean = {c: F.when(F.isnan(col(c).cast("double")) | (F.abs(col(c).cast("double")) == float("inf")),
                       F.lit(None)).otherwise(col(c).cast("double")) for c in num}
    aggs = []
    for c in num:
        aggs.append(F.avg(clean[c]).alias(f"m_{c}"))
        aggs.append(F.count_if(col(c).isNull() | F.isnan(col(c).cast("double"))).alias(f"n_{c}"))
        aggs.append(F.count_if(F.abs(col(c).cast("double")) == float("inf")).alias(f"i_{c}"))
    others = [c for c in cols if c not in num]
    for c in others:
        aggs.append(F.count_if(col(c).isNull()).alias(f"n_{c}"))
    row = df.agg(*aggs).first() if aggs else None
    report, sel = {}, []
    for f in df.schema.fields:
        c = f.name
        if c in num:
            m = row[f"m_{c}"]
            m = 0.0 if m is None else m
            is_inf = F.abs(col(c).cast("double")) == float("inf")
            sel.append(F.when(is_inf, F.lit(0.0)).otherwise(F.coalesce(clean[c], F.lit(m))).alias(c))
            report[c] = {"filled_mean": row[f"n_{c}"], "inf_to_zero": row[f"i_{c}"], "mean": m}
        elif c in others and row[f"n_{c}"]:
            report[c] = {"dropped_column": True}
        else:
            sel.append(col(c))
    return df.select(*sel), report


def infer_predictors(df: DataFrame, target: str | None = None, max_levels: int = 50) -> DataFrame:
    """Role per column: numeric / categorical (<= max_levels distinct) / unused."""
    from quarry.operators.profile import distinct_counts
    cols = [c for c in df.columns if c != target]
    num = set(numeric_columns(df, cols))
    other = [c for c in cols if c not in num]
    row = distinct_counts(df, other)
    rows = []
    for i, c in enumerate(cols):
        if c in num:
            rows.append((i, c, "numeric", None))
        else:
            nd = row[c]
            rows.append((i, c, "categorical" if nd <= max_levels else "unused", int(nd)))
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, role string, n_distinct long")


def regex_group_map(c: Column, groups: Sequence[tuple[str, str]]) -> Column:
    """First matching Java regex gives the label, else the original text."""
    s = c.cast("string")
    out = None
    for pattern, label in groups:
        out = (F.when(s.rlike(pattern), F.lit(label)) if out is None
               else out.when(s.rlike(pattern), F.lit(label)))
    return s if out is None else out.otherwise(s)


def numeric_only(df: DataFrame) -> DataFrame:
    """Numeric projection; error when nothing numeric is left."""
    num = numeric_columns(df)
    if not num:
        raise ValueError("no numeric columns to analyse")
    return df.select(*[col(c) for c in num])
