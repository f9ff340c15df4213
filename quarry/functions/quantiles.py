"""Exact quantiles (linear interpolation) of any number of rows, without a sort.

Few probabilities: a sketch gives each wanted rank a narrow bracket of values, one
pass counts the rows below every bracket and the distinct values inside it, and
running sums over those few values give the order statistics. Counts are exact, so
the result doesn't depend on the sketch; a bracket that misses its rank is opened up
and counted again. All columns, probabilities and groups share the passes.

Many probabilities (landmarks): the sketch gives bucket edges, buckets are counted,
and only distinct values with their counts move, one bucket per task.

Heavy ties are one distinct value each, whatever their number of rows. Nulls and NaN
don't count; a column without values has null quantiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

ACCURACY = 10_000
FEW = 32  # probabilities per pass by brackets


def _stacked(df: DataFrame, exprs: Sequence[Column], group: Sequence[str]) -> DataFrame:
    """(group..., __c, __v): one row per value."""
    values = F.array(*[F.struct(F.lit(i).alias("c"), e.cast("double").alias("v")) for i, e in enumerate(exprs)])
    d = df.select(*[F.col(f"`{g}`").alias(f"__g{k}") for k, g in enumerate(group)], F.explode(values).alias("__s"))
    d = d.select(*[f"__g{k}" for k in range(len(group))], F.col("__s.c").alias("__c"), F.col("__s.v").alias("__v"))
    return d.where(F.col("__v").isNotNull() & ~F.isnan("__v"))


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    """Ranks (from 0) around probability ``p`` of ``n`` values, and the weight of the upper."""
    at = p * (n - 1)
    low = math.floor(at)
    return low, min(low + 1, n - 1), at - low


def _pick(a: float, b: float, w: float) -> float:
    return a if a == b or w == 0 else (1 - w) * a + w * b


def grouped_quantiles(df: DataFrame, exprs: Sequence[Column], probs: Sequence[float], group: Sequence[str] = (),
                      accuracy: int = ACCURACY) -> dict[tuple, list[list[float | None]]]:
    """{group values: [per expression [quantile per probability]]}; groups that have
    no value of an expression have nulls there. The driver holds one number per
    group, expression and probability."""
    spark = df.sparkSession
    keys = [f"__g{k}" for k in range(len(group))]
    stacked = _stacked(df, exprs, group)
    out: dict[tuple, list] = {}
    for start in range(0, len(probs), FEW):
        part = list(probs[start:start + FEW])
        around = [x for p in part for x in (max(0.0, p - 3 / accuracy), min(1.0, p + 3 / accuracy))]
        sketch = stacked.groupBy(*keys, "__c").agg(
            F.count(F.lit(1)).alias("n"), F.percentile_approx("__v", around, accuracy).alias("q")).collect()
        want = {}  # (group, column, probability) -> ranks and bracket
        for r in sketch:
            g = tuple(r[k] for k in keys)
            rows = out.setdefault(g, [[None] * len(probs) for _ in exprs])
            for j, p in enumerate(part):
                lo, hi, w = _ranks(r["n"], p)
                small = r["n"] <= 4 * accuracy
                bracket = (-math.inf, math.inf) if small else (r["q"][2 * j], r["q"][2 * j + 1])
                want[(g, r["__c"], j)] = (lo, hi, w, bracket, rows)
        while want:
            types = [stacked.schema[k].dataType.simpleString() for k in keys]
            schema = ", ".join([*(f"{k} {t}" for k, t in zip(keys, types)), "__c int, __j int, lo double, hi double, r0 long, r1 long"])
            table = spark.createDataFrame(
                [(*g, c, j, *v[3], v[0], v[1]) for (g, c, j), v in want.items()], schema)
            on = [*[stacked[k].eqNullSafe(table[k]) for k in keys], stacked["__c"] == table["__c"]]
            met = stacked.join(F.broadcast(table), on).where(stacked["__v"] <= table["hi"])
            cell = F.when(stacked["__v"] >= table["lo"], stacked["__v"])  # null: below the bracket
            cells = met.groupBy(*[table[k].alias(f"k{i}") for i, k in enumerate(keys)], table["__c"].alias("c"), table["__j"].alias("j"),
                                "r0", "r1", cell.alias("v")).agg(F.count(F.lit(1)).alias("n"))
            by = [*[f"k{i}" for i in range(len(keys))], "c", "j"]
            run = F.sum("n").over(Window.partitionBy(*by).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
            got = cells.withColumn("upto", run).groupBy(*by).agg(
                F.max(F.when(F.col("v").isNull(), F.col("n"))).alias("below"),
                F.min(F.when(F.col("upto") > F.col("r0"), F.col("v"))).alias("a"),
                F.min(F.when(F.col("upto") > F.col("r1"), F.col("v"))).alias("b")).collect()
            missed = dict(want)
            for r in got:
                key = (tuple(r[f"k{i}"] for i in range(len(keys))), r["c"], r["j"])
                lo, hi, w, _, rows = want[key]
                if (r["below"] or 0) <= lo and r["a"] is not None and r["b"] is not None:
                    rows[r["c"]][start + r["j"]] = _pick(r["a"], r["b"], w)
                    del missed[key]
            want = {k: (v[0], v[1], v[2], (-math.inf, math.inf), v[4]) for k, v in missed.items()}
    return out


def landmarks(df: DataFrame, exprs: Sequence[Column], probs: Sequence[float], accuracy: int = ACCURACY) -> list[list[float | None]]:
    """Exact quantiles at many probabilities, per expression."""
    from pyspark.ml.feature import Bucketizer
    out = []
    for e in exprs:
        x = df.select(e.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
        grid = [i / 512 for i in range(1, 512)]
        row = x.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", grid, accuracy).alias("q")).first()
        if not row["n"]:
            out.append([None] * len(probs))
            continue
        splits = [-math.inf, *sorted(set(row["q"])), math.inf]
        cells = (Bucketizer(splits=splits, inputCol="v", outputCol="b", handleInvalid="keep").transform(x)
                 .groupBy("b", "v").agg(F.count(F.lit(1)).alias("n")))
        sizes = {r["b"]: r["n"] for r in cells.groupBy("b").agg(F.sum("n").alias("n")).collect()}
        ranks = sorted({r for p in probs for r in _ranks(row["n"], p)[:2]})
        before, wanted = 0, []
        for b in sorted(sizes):
            wanted += [(b, r, r - before) for r in ranks if before <= r < before + sizes[b]]
            before += sizes[b]
        table = df.sparkSession.createDataFrame(wanted, "b double, r long, inside long")
        run = F.sum("n").over(Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        placed = cells.withColumn("upto", run)
        hit = placed.join(F.broadcast(table), "b").where((F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("n")))
        value = {r["r"]: r["v"] for r in hit.select("r", "v").collect()}
        out.append([_pick(value[lo], value[hi], w) for lo, hi, w in (_ranks(row["n"], p) for p in probs)])
    return out


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """{column: [quantile per probability]}, exact at any size."""
    from quarry.functions.exprs import to_double
    if not cols:
        return {}
    exprs = [to_double(c) for c in cols]
    if len(probs) > FEW:
        return dict(zip(cols, landmarks(df, exprs, probs)))
    got = grouped_quantiles(df, exprs, probs).get((), [[None] * len(probs) for _ in cols])
    return dict(zip(cols, got))


def quantile(df: DataFrame, expr: Column, p: float) -> float | None:
    got = grouped_quantiles(df, [expr], [p])
    return got[()][0][0] if got else None
