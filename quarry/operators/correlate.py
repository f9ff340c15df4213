"""Correlation matrices in long form.

* Pearson: one aggregation computes every pair's ``covar_pop`` and the two
  population sds over the rows where both values are present
  (pairwise-complete, like pandas). r = covar / (sd_a * sd_b) through
  ``try_divide`` so a constant column gives NULL instead of an ANSI error.
* Spearman: Pearson on average ranks. Ranks of all columns come from one
  stacked (column, value) count table, cached while it is used, and distributed
  prefix sums (range buckets on each column's own quantile edges, a cumulative
  window inside each bucket only); ranks are joined back per column (broadcast
  when the counted rank table is small enough).
* Kendall tau-b: see ``kendall``.
"""

from __future__ import annotations

from itertools import combinations_with_replacement
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from quarry.functions.exprs import col, numeric_columns, to_double

BROADCAST_MAX_ROWS = 2_000_000  # rank table rows below which it is broadcast


def pearson(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A5: long form (col_a, col_b, r), all ordered pairs incl. the diagonal."""
    cols = numeric_columns(df, cols)
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    aggs = []
    for k, (i, j) in enumerate(pairs):
        a, b = to_double(cols[i]), to_double(cols[j])
        both = a.isNotNull() & b.isNotNull()
        aa, bb = F.when(both, a), F.when(both, b)
        aggs += [F.covar_pop(aa, bb).alias(f"cov{k}"), F.stddev_pop(aa).alias(f"sa{k}"),
                 F.stddev_pop(bb).alias(f"sb{k}")]
    wide = df.agg(*aggs)
    structs = []
    for k, (i, j) in enumerate(pairs):
        r = F.try_divide(F.col(f"cov{k}"), F.col(f"sa{k}") * F.col(f"sb{k}"))
        # clamp float noise just outside [-1, 1]
        r = F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))
        structs.append(F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"), r.alias("r")))
        if i != j:
            structs.append(F.struct(F.lit(cols[j]).alias("col_a"), F.lit(cols[i]).alias("col_b"), r.alias("r")))
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def rank_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(ci, v, cnt): the distinct values of every column, counted in ONE pass."""
    long = (df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ci"), to_double(c).alias("v"))
                                          for i, c in enumerate(cols)])).alias("s"))
            .select("s.*").where(F.col("v").isNotNull()))
    return long.groupBy("ci", "v").agg(F.count(F.lit(1)).alias("cnt"))


def rank_tables(df: DataFrame, cols: Sequence[str], cells: DataFrame | None = None) -> DataFrame:
    """(ci, v, rank): average ranks of every column's distinct values, by prefix
    sums over buckets of each column's own edges. ``cells``: ``rank_cells`` of the
    same columns, when the caller keeps them."""
    from quarry.functions.prefix import prefix_sums
    cells = rank_cells(df, cols) if cells is None else cells
    ranked = prefix_sums(cells, "v", ["cnt"], group="ci")
    return ranked.select("ci", "v", (F.col("cnt_cum") + (F.col("cnt") + 1) / 2.0).alias("rank"))


def _attach_ranks(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[DataFrame]]:
    """The columns as ranks, and what is cached for them."""
    out = df.select(*[to_double(c).alias(c) for c in cols])
    cells = rank_cells(out, cols).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["ci"]: r["count"] for r in cells.groupBy("ci").count().collect()}  # a row per column
    ranks = rank_tables(out, cols, cells).persist(StorageLevel.MEMORY_AND_DISK)
    for i, c in enumerate(cols):
        rk = ranks.where(F.col("ci") == i).select(F.col("v").alias(f"__v_{c}"), F.col("rank").alias(f"__r_{c}"))
        # one row per distinct value: broadcast only below a counted size,
        # otherwise a shuffle join (AQE splits a hot value's partition)
        side = F.broadcast(rk) if sizes.get(i, 0) <= BROADCAST_MAX_ROWS else rk
        out = out.join(side, col(c) == F.col(f"__v_{c}"), "left").drop(f"__v_{c}")
    return out.select(*[F.col(f"__r_{c}").alias(c) for c in cols]), [cells, ranks]


def _rank_pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson of the ranks, p x p rows, computed while the rank tables are cached."""
    ranked, cached = _attach_ranks(df, cols)
    part = pearson(ranked, cols)
    out = df.sparkSession.createDataFrame(part.collect(), part.schema)
    for c in cached:
        c.unpersist()
    return out


def spearman(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Spearman = Pearson on average ranks (pairwise-complete)."""
    cols = numeric_columns(df, cols)
    nulls = df.agg(*[F.count_if(to_double(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    if not any(nulls[f"n{i}"] for i in range(len(cols))):
        return _rank_pearson(df, cols)
    # with missing values each pair is ranked on its own complete rows
    out = None
    for i, a in enumerate(cols):
        for b in cols[i:]:
            sub = df.where(to_double(a).isNotNull() & to_double(b).isNotNull())
            pc = [a] if a == b else [a, b]
            part = _rank_pearson(sub, pc)
            if a != b:
                part = part.where(F.col("col_a") != F.col("col_b"))
            out = part if out is None else out.unionByName(part)
    return out


def correlations(df: DataFrame, cols: Sequence[str] | None = None,
                 methods: Sequence[str] = ("pearson", "spearman", "kendall")) -> DataFrame:
    """Union of the methods with a ``method`` column (computed once each)."""
    fn = {"pearson": pearson, "spearman": spearman, "kendall": kendall}
    out = None
    for m in methods:
        part = fn[m](df, cols).withColumn("method", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out


def kendall(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Kendall tau-b matrix, long form."""
    from quarry.operators.kendall import kendall_matrix
    return kendall_matrix(df, numeric_columns(df, cols))
