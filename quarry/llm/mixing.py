"""Operator 6: mix sources to target weights by systematic sampling.

Every document of a source expects ``target / source_size`` copies. Documents of
a source are put in a fixed order, their expected copies are summed along it, one
offset in [0, 1) is added, and a document is emitted once for each integer that
its stretch of the sum crosses. The order goes by size class, then by a hash of
the id, so long and short documents are thinned or repeated alike and the words
taken stay near the target.

The running sum needs no window over a whole source: counts per (source, size
class, hash slice) give every slice its offset, and rows are numbered inside a
slice only. The slice is a prefix of the hash that also orders the rows, so the
number of slices never changes the result.

Defined cases: a null text has size 0; a null source is a source of its own and
comes last; a null id hashes as the empty text; rows that repeat are separate
documents; sources without words get target 0 and 0 copies; an input column named
like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import WORD, key_of, need, without

OUT = ("size", "source_size", "target", "copies")
WEIGHTS = (5.0, 2.0, 1.0)


def n_words(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """``sizes``: one row per source (source, source_size). Adds ``target``.

    Weights go round the sources in code point order. Sharing, cutting at ``cap``
    times the size and sharing the excess again until nothing is above its cap
    ends at one level: capped sources are a prefix in the order of size per
    weight, so running sums find the level in one pass. The table has a row per
    source, which is why its windows may run in one task."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_level = W.orderBy("__per_weight", F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    d = (sizes.withColumn("__w", F.element_at(w, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
         .withColumn("__per_weight", F.col("source_size") / F.col("__w"))
         .withColumn("__total", F.sum("source_size").over(W.partitionBy()))
         .withColumn("__before", F.coalesce(F.sum("source_size").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("__w_left", F.sum("__w").over(by_level.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("__capped", (F.col("__total") - cap * F.col("__before")) * F.col("__w")
                     > cap * F.col("source_size") * F.col("__w_left")))
    fixed = F.sum(F.when(F.col("__capped"), F.col("source_size")).otherwise(0)).over(W.partitionBy())
    free = F.sum(F.when(F.col("__capped"), 0.0).otherwise(F.col("__w"))).over(W.partitionBy())
    level = (F.col("__total") - cap * fixed) / F.when(free > 0, free)
    target = F.when(F.col("__capped"), cap * F.col("source_size")).otherwise(F.col("__w") * level)
    return d.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = 3.0, seed: int = 17,
        slice_digits: int = 3) -> DataFrame:
    """All rows and columns of ``docs`` with size, source_size, target and copies.

    ``slice_digits``: hex digits of the order hash per slice (16 to that power
    slices per source and size class)."""
    need(docs, "doc_id", "text", "source")
    rows = without(docs, *OUT).withColumn("size", n_words(F.col("text")))
    bits = F.length(F.bin("size"))
    rows = (rows.withColumn("__src", key_of(F.col("source")))
            .withColumn("__hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
            .withColumn("__bits", bits)
            .withColumn("__class", F.expr("__bits * 4 + (shiftright(size, greatest(__bits - 3, 0)) & 3)"))
            .drop("__bits")
            .withColumn("__slice", F.substring("__hash", 1, slice_digits)))
    slices = rows.groupBy("__src", "__class", "__slice").agg(
        F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__size"), F.max("source").alias("source"))
    classes = slices.groupBy("__src", "__class").agg(
        F.sum("__n").alias("__n"), F.sum("__size").alias("__size"), F.max("source").alias("source"))
    targets = source_targets(
        classes.groupBy("source").agg(F.sum("__size").alias("source_size")), weights, cap
    ).withColumn("__src", key_of(F.col("source"))).drop("source")
    up = W.unboundedPreceding
    base = classes.select("__src", "__class", F.coalesce(
        F.sum("__n").over(W.partitionBy("__src").orderBy("__class").rowsBetween(up, -1)), F.lit(0)).alias("__base"))
    starts = (slices.select("__src", "__class", "__slice", F.coalesce(
        F.sum("__n").over(W.partitionBy("__src", "__class").orderBy("__slice").rowsBetween(up, -1)), F.lit(0)).alias("__in"))
        .join(base, ["__src", "__class"]).join(targets, "__src"))
    inside = W.partitionBy("__src", "__class", "__slice").orderBy("__hash", "doc_id", "size")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("__src")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    out = (rows.join(starts, ["__src", "__class", "__slice"])
           .withColumn("__rank", F.col("__base") + F.col("__in") + F.row_number().over(inside))
           .withColumn("__u", offset).withColumn("__each", each))
    copies = F.floor(F.col("__u") + F.col("__each") * F.col("__rank")) - F.floor(F.col("__u") + F.col("__each") * (F.col("__rank") - 1))
    out = out.withColumn("copies", copies)
    keep = [F.col(f"`{c}`") for c in without(docs, *OUT).columns]
    return out.select(*keep, *OUT)


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as ``copies`` says; ``copy`` counts from 1."""
    d = without(mixed, "copy").filter(F.col("copies") > 0)
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def op6_mix(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import read_table
    m = mix(read_table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS wt FROM s),
l AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
        coalesce(sum(source_size) OVER (ORDER BY source_size / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
        sum(wt) OVER (ORDER BY source_size / wt, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
c AS (SELECT *, (total - 3.0::DOUBLE * before) * wt > 3.0::DOUBLE * source_size * w_left AS capped FROM l),
t AS (SELECT source, source_size, coalesce(CASE WHEN capped THEN 3.0::DOUBLE * source_size ELSE wt * (
        (total - 3.0::DOUBLE * sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER ()::BIGINT)
        / nullif(sum(CASE WHEN capped THEN 0.0::DOUBLE ELSE wt END) OVER (), 0)) END, 0.0::DOUBLE) AS target FROM c),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS each,
        ('0x' || substr(md5('17|' || coalesce('=' || d.source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u,
        row_number() OVER (PARTITION BY d.source ORDER BY
          length(bin(d.size)) * 4 + ((d.size >> greatest(length(bin(d.size)) - 3, 0)) & 3),
          md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(u + each * k) - floor(u + each * (k - 1)))::BIGINT * size)::BIGINT AS taken FROM o
"""
