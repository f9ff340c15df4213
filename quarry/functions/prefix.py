"""Distributed prefix sums over an ordered key (no single-task global window).

Each group has edges of its own, from a quantile sketch of its keys, and as many
buckets as its rows need (``ROWS_PER_BUCKET`` each, at most ``N_BUCKETS``); so a
narrow group beside a wide one, or a large one beside small ones, is still cut
evenly. A row finds its bucket by binary search in its group's edges (unrolled,
a projection per halving, inside codegen). Totals per (group, bucket), summed over
a group's buckets in order, are the offsets; the running sum is a window
partitioned by (group, bucket). Used for ranks, ROC/PR curves, AUC, average
precision and cumulative counts.

Edges and offsets are broadcast only when they are counted and small. Beyond
that they are joined by key; the offsets then share the partitioning that the
window needs, so that join costs no shuffle of its own.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F

N_BUCKETS = 512  # buckets of a group at most
ROWS_PER_BUCKET = 10_000
MAX_EDGE_GROUPS = 256  # groups whose edges are fetched and broadcast (at most 4 KB each)
MAX_OFFSETS = 100_000  # (group, bucket) rows that are broadcast


def group_edges(keyed: DataFrame, n_buckets: int = N_BUCKETS, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(__g, __n, __e): rows and ascending inner edges of every group of (__g, __k)."""
    probs = F.expr("array(" + ", ".join(f"{i / n_buckets!r}D" for i in range(1, n_buckets)) + ")")
    finite = F.when(~F.isnan("__k"), F.col("__k"))
    per = keyed.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"),
                                   F.percentile_approx(finite, probs, 4 * n_buckets).alias("__q"))
    want = F.least(F.lit(n_buckets), F.ceil(F.col("__n") / F.lit(rows_per_bucket))).cast("int")
    picked = F.when(F.col("__q").isNotNull() & (want > 1), F.transform(
        F.sequence(F.lit(1), F.greatest(want - 1, F.lit(1))),
        lambda i: F.get("__q", F.floor(i * F.lit(n_buckets) / want).cast("int") - 1)))
    none = F.array().cast("array<double>")
    return per.select("__g", "__n", F.coalesce(F.array_sort(F.array_distinct(picked)), none).alias("__e"))


def _with_bucket(keyed: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """Column __b: how many of the group's edges (``most`` at most) are not above the
    key; missing keys and NaN come last."""
    out = keyed.join(edges.select("__g", "__e"), "__g").withColumn("__b", F.lit(0))
    step = 1 << most.bit_length() >> 1
    while step:
        ahead = F.col("__b") + F.lit(step)
        fits = F.get("__e", ahead - 1) <= F.col("__k")
        out = out.withColumn("__b", F.when(fits, ahead).otherwise(F.col("__b")))
        step //= 2
    last = F.col("__k").isNull() | F.isnan("__k")
    return out.withColumn("__b", F.when(last, F.lit(most + 1)).otherwise(F.col("__b"))).drop("__e")


def prefix_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str], group: str | None = None,
                descending: bool = False, inclusive: bool = False,
                n_buckets: int = N_BUCKETS, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``{c}_cum`` = sum of ``c`` over rows ordered before this one (within
    ``group``); ``inclusive`` also counts the row itself. ``order_col`` must be
    unique within a group (aggregate to distinct values first). Rows without a
    group are left out. ``df`` is read three times: cache it when it is costly."""
    key = (-F.col(order_col) if descending else F.col(order_col)).cast("double")
    work = df.withColumn("__k", key).withColumn("__g", F.col(group) if group else F.lit(0))
    work = work.where(F.col("__g").isNotNull())
    edges = group_edges(work.select("__g", "__k"), n_buckets, rows_per_bucket)
    few = edges.take(MAX_EDGE_GROUPS + 1)
    small = len(few) <= MAX_EDGE_GROUPS
    if small:
        edges = F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in few], edges.schema))
    work = _with_bucket(work, edges, max((len(r["__e"]) for r in few), default=0) if small else n_buckets - 1)
    totals = work.groupBy("__g", "__b").agg(*[F.sum(c).alias(c) for c in sum_cols])
    before = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    amount = {c: F.when(F.isnan(F.col(c).cast("double")), F.lit(0.0)).otherwise(F.col(c).cast("double")) for c in sum_cols}
    offs = totals.select("__g", "__b", *[F.coalesce(F.sum(amount[c]).over(before), F.lit(0.0)).alias(f"__o_{c}")
                                         for c in sum_cols])
    if small and sum(len(r["__e"]) + 2 for r in few) <= MAX_OFFSETS:
        offs = F.broadcast(offs)
    frame = (Window.unboundedPreceding, 0 if inclusive else -1)
    w = Window.partitionBy("__g", "__b").orderBy("__k").rowsBetween(*frame)
    out = work.join(offs, ["__g", "__b"])
    for c in sum_cols:
        out = out.withColumn(f"{c}_cum", F.col(f"__o_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0)))
    return out.drop("__k", "__g", "__b", *[f"__o_{c}" for c in sum_cols])
