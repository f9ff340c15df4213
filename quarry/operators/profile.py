"""Profiling aggregates.

Every profile is a single ``agg`` over the table (partial aggregation on
executors, a few bytes per column shipped to the driver) followed by a
``stack`` into long form. Histograms use min/max from one pass and a
``groupBy(bin)`` in the second.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.exprs import (
    col, numeric_columns, to_double)
from quarry.functions.quantiles import column_quantiles

DESCRIBE_PROBS = [0.25, 0.5, 0.75, 1.0]


def _stack_long(wide: DataFrame, cols: Sequence[str], fields: Sequence[str],
                name_col: str = "column") -> DataFrame:
    """Turn one wide row (``{i}__{field}`` columns) into one row per column."""
    parts = []
    for i, c in enumerate(cols):
        parts.append(F.struct(F.lit(c).alias(name_col),
                              *[F.col(f"c{i}__{f}").alias(f) for f in fields]))
    return wide.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def describe(df: DataFrame, cols: Sequence[str] | None = None, name_width: int | None = None) -> DataFrame:
    """N, min, max, mean, sd (sample), 25/50/75/100 % per numeric column.

    ``sd`` is NULL for n <= 1 (pandas semantics). ``name_width`` cuts names
    (the reference shows 10 characters).
    """
    cols = numeric_columns(df, cols)
    quantiles = column_quantiles(df, cols, DESCRIBE_PROBS)
    aggs = []
    for i, c in enumerate(cols):
        x = to_double(c)
        aggs += [F.count(x).alias(f"c{i}__n"), F.min(x).alias(f"c{i}__min"),
                 F.max(x).alias(f"c{i}__max"), F.avg(x).alias(f"c{i}__mean"),
                 F.stddev_samp(x).alias(f"c{i}__sd"),
                 F.array(*[F.lit(q).cast("double") for q in quantiles[c]]).alias(f"c{i}__q")]
    wide = df.agg(*aggs)
    fields = ["n", "min", "max", "mean", "sd", "q"]
    out = _stack_long(wide, cols, fields)
    name = F.col("column") if not name_width else F.substring("column", 1, name_width)
    return out.select(
        name.alias("column"), "n", "min", "max", "mean",
        F.when(F.col("n") > 1, F.col("sd")).alias("sd"),
        F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"), F.col("q")[3].alias("p100"))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Exact distinct non-null values of every column: cells stacked as (column,
    value) and grouped once, so a column's hot value is counted before the shuffle
    and no row is carried along whole."""
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def text(c: str):
        x = col(c)
        if types[c] in ("double", "float"):
            x = x + F.lit(0.0)  # -0.0 is 0.0
        elif types[c] == "timestamp":
            x = F.unix_micros(x)  # the clock change repeats an hour in text form
        return x.cast("string")
    if not cols:
        return {}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), text(c).alias("v")) for i, c in enumerate(cols)]))
    rows = (df.select(cells.alias("s")).select("s.*").where(F.col("v").isNotNull())
            .groupBy("i", "v").agg(F.lit(1).alias("one")).groupBy("i").count().collect())  # a row per column
    found = {r["i"]: r["count"] for r in rows}
    return {c: found.get(i, 0) for i, c in enumerate(cols)}


def detect_categorical(df: DataFrame, max_levels: int = 50) -> DataFrame:
    """A3: non-numeric columns, or integer columns with <= max_levels distinct
    values and min >= 0."""
    distinct = distinct_counts(df, df.columns)
    aggs = []
    for i, f in enumerate(df.schema.fields):
        aggs.append(F.lit(distinct[f.name]).cast("long").alias(f"c{i}__n_distinct"))
        is_int = f.dataType.typeName() in ("integer", "long", "short", "byte")
        aggs.append((F.min(col(f.name)).cast("double") if is_int else F.lit(None).cast("double"))
                    .alias(f"c{i}__min"))
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    kinds = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        kinds.append("integer" if t in ("integer", "long", "short", "byte")
                     else "numeric" if t in ("double", "float", "decimal") else "text")
    out = _stack_long(wide, df.columns, ["n_distinct", "min"])
    kind = F.element_at(F.create_map(*[x for c, k in zip(df.columns, kinds)
                                       for x in (F.lit(c), F.lit(k))]), F.col("column"))
    is_cat = ((kind == "text")
              | ((kind == "integer") & (F.col("n_distinct") <= max_levels) & (F.col("min") >= 0)))
    return out.select("column", kind.alias("kind"), "n_distinct", is_cat.alias("is_categorical"))


def detect_blanks_zeros(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A4: does each selected column hold a blank (NULL/NaN) or an exact zero?"""
    cols = list(dict.fromkeys(cols or df.columns))  # ordered unique
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    aggs = []
    for i, c in enumerate(cols):
        blank = col(c).isNull()
        if types[c] in ("double", "float"):
            blank = blank | F.isnan(col(c))
        zero = (col(c) == 0) if types[c] != "string" else F.lit(False)
        aggs += [F.bool_or(blank).alias(f"c{i}__has_blank"),
                 F.coalesce(F.bool_or(zero), F.lit(False)).alias(f"c{i}__has_zero")]
    return _stack_long(df.agg(*aggs), cols, ["has_blank", "has_zero"])


def value_counts(df: DataFrame, c: str, normalize: bool = False) -> DataFrame:
    """Counts per value, descending (NULLs excluded)."""
    out = df.where(col(c).isNotNull()).groupBy(col(c).alias("value")).count()
    if normalize:
        total = df.where(col(c).isNotNull()).agg(F.count(F.lit(1))).first()[0]
        out = out.withColumn("share", F.try_divide(F.col("count"), F.lit(total)))
    return out.orderBy(F.desc("count"), F.asc("value"))


def _min_max(df: DataFrame, cols: Sequence[str]) -> dict:
    row = df.agg(*[x for i, c in enumerate(cols) for x in
                   (F.min(to_double(c)).alias(f"lo{i}"), F.max(to_double(c)).alias(f"hi{i}"))]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def bin_index(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin 0..bins-1 (last bin closed), numpy-histogram style."""
    if hi == lo:
        return F.when(x.isNotNull(), F.lit(0))
    idx = F.floor((x - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo)).cast("int")
    return F.least(F.greatest(idx, F.lit(0)), F.lit(bins - 1))


def histogram(df: DataFrame, c: str, bins: int = 20, lo: float | None = None,
              hi: float | None = None) -> DataFrame:
    """Equal-width histogram; empty bins kept, with their edges."""
    if lo is None or hi is None:
        lo, hi = _min_max(df, [c])[c]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, count long")
    x = to_double(c)
    counts = (df.where(x.isNotNull()).groupBy(bin_index(x, lo, hi, bins).alias("bin")).count())
    width = (hi - lo) / bins if hi > lo else 0.0
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    grid = grid.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                       (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"))
    # grid has `bins` rows (a parameter, not data): safe to broadcast
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin", "lo", "hi", F.coalesce("count", F.lit(0)).alias("count")))


def histogram2d(df: DataFrame, cx: str, cy: str, bins: int = 40) -> DataFrame:
    """Two-dimensional equal-width histogram (non-empty cells)."""
    mm = _min_max(df, [cx, cy])
    (xl, xh), (yl, yh) = mm[cx], mm[cy]
    x, y = to_double(cx), to_double(cy)
    return (df.where(x.isNotNull() & y.isNotNull())
            .groupBy(bin_index(x, xl, xh, bins).alias("bin_x"), bin_index(y, yl, yh, bins).alias("bin_y"))
            .count())


def pair_view(df: DataFrame, cx: str, cy: str, bins: int = 20, fraction: float = 0.05,
              seed: int = 42):
    """Seeded sample of (x, y) points for a scatter plus both histograms.
    The sample is hash-based (xxhash64 of seed and values), so it does not
    depend on partitioning."""
    keep = F.pmod(F.xxhash64(F.lit(seed), col(cx), col(cy)), F.lit(1_000_000)) < F.lit(int(fraction * 1_000_000))
    pts = df.where(keep).select(col(cx).alias("x"), col(cy).alias("y"))
    return pts, histogram(df, cx, bins), histogram(df, cy, bins)


def preview(df: DataFrame, c: str, order_by: Sequence[str], n: int = 200) -> DataFrame:
    """First ``n`` non-null values in key order (the limit is the feature)."""
    return df.where(col(c).isNotNull()).orderBy(*[col(k) for k in order_by]).limit(n)


def mean_sd(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population sd per column."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(to_double(c)).alias(f"c{i}__mean"),
                 F.stddev_pop(to_double(c)).alias(f"c{i}__sd_pop")]
    return _stack_long(df.agg(*aggs), cols, ["mean", "sd_pop"])


def _kernel_sums(batches, grid, bw):
    """(point, s): Gaussian kernel sums of a partition's values at the grid points."""
    import numpy as np
    import pyarrow as pa
    total, some = np.zeros(len(grid)), False
    for batch in batches:
        x = batch.column(0).to_numpy(zero_copy_only=False)
        for a in range(0, len(x), 4096):
            u = (grid[:, None] - x[None, a:a + 4096]) / bw
            total += np.exp(-0.5 * u * u).sum(axis=1)
            some = True
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(total)], ["point", "s"])


def kde_curve(df: DataFrame, c: str, grid_points: int = 200, bandwidth: float | None = None,
              fine_bins: int | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid (Scott's rule bandwidth).

    The kernel of every row is summed at the grid points, per partition in numpy and
    then by Spark, so the driver gets ``grid_points`` sums. With ``fine_bins`` the
    means of that many even bins stand for their rows: cheaper, but not exact where
    a bin isn't narrow against the bandwidth.
    """
    import numpy as np
    x = to_double(c)
    st = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"),
                F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    n, sd, lo, hi = st["n"], st["sd"] or 0.0, st["lo"], st["hi"]
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "point int, x double, density double")
    bw = bandwidth or (sd * n ** (-1.0 / 5) if sd > 0 else 1.0)
    grid = np.linspace(lo, hi, grid_points) if hi > lo else np.full(grid_points, lo)
    if fine_bins is None:
        sums = (df.where(x.isNotNull()).select(x.alias("x")).mapInArrow(lambda it: _kernel_sums(it, grid, bw), "point int, s double")
                .groupBy("point").agg(F.sum("s").alias("s")).collect())
        total = np.zeros(grid_points)
        total[[r["point"] for r in sums]] = [r["s"] for r in sums]
    else:
        counts = (df.where(x.isNotNull()).groupBy(bin_index(x, lo, hi, fine_bins).alias("b"))
                  .agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m")).collect())
        centers = np.array([r["m"] for r in counts], dtype=float)
        weights = np.array([r["n"] for r in counts], dtype=float)
        u = (grid[:, None] - centers[None, :]) / bw
        total = (np.exp(-0.5 * u * u) * weights[None, :]).sum(axis=1)
    dens = total / (n * bw * np.sqrt(2 * np.pi))
    return spark.createDataFrame([(i, float(g), float(d)) for i, (g, d) in enumerate(zip(grid, dens))],
                                 "point int, x double, density double")


def quantile_boundaries(df: DataFrame, c: str, q: int = 4) -> DataFrame:
    """Quantile edges of a column (for drawing over its histogram)."""
    probs = [j / q for j in range(q + 1)]
    edges = column_quantiles(df, [c], probs)[c]
    return df.sparkSession.createDataFrame(
        [(j, float(p), edges[j]) for j, p in enumerate(probs)],
        "edge int, prob double, value double")


def dataset_profile(df: DataFrame, moderate_cells: int = 500_000, large_cells: int = 1_000_000) -> DataFrame:
    """Rows, columns, cells, first/last column name and a size note."""
    n_cols = len(df.columns)
    first, last = (df.columns[0], df.columns[-1]) if n_cols else (None, None)
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    cells = F.col("n_rows") * F.lit(n_cols)
    return rows.select(
        "n_rows", F.lit(n_cols).cast("long").alias("n_columns"), cells.alias("n_cells"),
        F.lit(first).alias("first_column"), F.lit(last).alias("last_column"),
        F.when(cells >= large_cells, F.lit("large"))
         .when(cells >= moderate_cells, F.lit("moderate")).otherwise(F.lit("small")).alias("size_note"))
