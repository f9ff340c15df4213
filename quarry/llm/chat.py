"""Operator 7: chat formatting after a cumulative-snapshot collapse.

A chat logged after every turn leaves conversations that are prefixes of longer
ones. Each turn gets a 128-bit hash of its position, role and text; the running
sum of these over a conversation's turns is a rolling hash of its prefixes (the
position is hashed too, so order counts). A conversation whose whole hash equals
a proper prefix of another one is dropped by an anti-join, and of conversations
that are equal throughout the smallest id stays. What is left is maximal and is
rendered.

A conversation of any length is split into blocks of ``block`` turns: block sums
give every block its start, running sums stay inside a block, and the text is
rendered per block, so a conversation with a third of all turns is spread over
tasks. ``part`` numbers the rendered blocks; conversations of up to ``block``
turns have one row.

Defined cases: turns with a null conv_id belong to one conversation with a null
id; turns are ordered by turn (null first), role, text; a null role renders as
``unknown`` and a null text as nothing; rows that repeat are turns like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import key_of, need, read_table

TURN = "<|{role}|>\n{text}\n<|end|>\n"
ORDER = ("turn", "role", "text")


def _positions(turns: DataFrame, slice_turns: int) -> DataFrame:
    """``__pos`` (from 1) of each turn, without a window over a whole conversation:
    turns are cut by their number, and counts per cut give each its start."""
    d = turns.withColumn("__cut", F.coalesce(F.floor(F.col("turn") / slice_turns), F.lit(-(2 ** 62)).cast("long")))
    cuts = d.groupBy("__conv", "__cut").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("__conv").orderBy("__cut").rowsBetween(W.unboundedPreceding, -1)
    starts = cuts.select("__conv", "__cut", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy("__conv", "__cut").orderBy(*ORDER)
    return (d.join(starts, ["__conv", "__cut"])
            .withColumn("__pos", F.col("__start") + F.row_number().over(inside)).drop("__cut", "__start"))


def prefix_hashes(placed: DataFrame, block: int) -> DataFrame:
    """(__conv, __pos, __a, __b): the rolling hash of the prefix that ends at __pos."""
    role, text = F.coalesce(F.col("role"), F.lit("\0")), F.coalesce(F.col("text"), F.lit("\0"))
    d = placed.select(
        "__conv", "__pos", F.floor((F.col("__pos") - 1) / block).alias("__block"),
        F.xxhash64(F.col("__pos"), role, text).cast("decimal(20,0)").alias("__a"),
        F.xxhash64(F.lit("b"), text, role, F.col("__pos")).cast("decimal(20,0)").alias("__b"))
    sums = d.groupBy("__conv", "__block").agg(F.sum("__a").alias("__sa"), F.sum("__b").alias("__sb"))
    before = W.partitionBy("__conv").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    starts = sums.select("__conv", "__block",
                         F.coalesce(F.sum("__sa").over(before).cast("decimal(38,0)"), zero).alias("__sa"),
                         F.coalesce(F.sum("__sb").over(before).cast("decimal(38,0)"), zero).alias("__sb"))
    run = W.partitionBy("__conv", "__block").orderBy("__pos").rowsBetween(W.unboundedPreceding, 0)
    return d.join(starts, ["__conv", "__block"]).select(
        "__conv", "__pos", (F.col("__sa") + F.sum("__a").over(run)).cast("string").alias("__a"),
        (F.col("__sb") + F.sum("__b").over(run)).cast("string").alias("__b"))


def maximal(turns: DataFrame, block: int = 1024) -> DataFrame:
    """All turns, with ``__pos``, of the conversations that no longer one extends."""
    need(turns, "conv_id", "turn", "role", "text")
    t = turns.select("conv_id", "turn", "role", "text", key_of(F.col("conv_id")).alias("__conv"))
    placed = _positions(t, block)
    prefixes = prefix_hashes(placed, block)
    lengths = placed.groupBy("__conv").agg(F.max("__pos").alias("__len"), F.min("conv_id").alias("__id"))
    marked = prefixes.join(lengths, "__conv")
    whole = (marked.filter("__pos = __len").groupBy("__pos", "__a", "__b")
             .agg(F.min(F.struct(F.col("__id").isNull().alias("n"), F.col("__id"), F.col("__conv"))).alias("__first")))
    proper = marked.filter("__pos < __len").select("__pos", "__a", "__b").distinct()
    keep = whole.join(proper, ["__pos", "__a", "__b"], "left_anti").select(F.col("__first.__conv").alias("__conv"))
    return placed.join(keep, "__conv", "left_semi")


def render(kept: DataFrame, block: int = 1024) -> DataFrame:
    """conv_id, part, n_turns (of the part), text."""
    head, tail = TURN.split("{role}")[0], TURN.split("{text}")[1]
    middle = TURN.split("{role}")[1].split("{text}")[0]
    one = F.concat(F.lit(head), F.coalesce(F.col("role"), F.lit("unknown")), F.lit(middle),
                   F.coalesce(F.col("text"), F.lit("")), F.lit(tail))
    d = kept.withColumn("part", F.floor((F.col("__pos") - 1) / block)).withColumn("__t", F.struct("__pos", one.alias("t")))
    g = d.groupBy("__conv", "part").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_turns"),
                                        F.sort_array(F.collect_list("__t")).alias("__ts"))
    return g.select("conv_id", "part", "n_turns",
                    F.array_join(F.transform("__ts", lambda x: x["t"]), "").alias("text"))


def format_chats(turns: DataFrame, block: int = 1024) -> DataFrame:
    return render(maximal(turns, block), block)


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, list(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts,
    list('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10)
         ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rs
  FROM conversations GROUP BY conv_id),
p AS (SELECT DISTINCT k, md5(array_to_string(list_slice(ts, 1, k), chr(3))) AS h FROM (SELECT ts, unnest(range(1, len(ts))) AS k FROM c)),
w AS (SELECT len(ts) AS k, md5(array_to_string(ts, chr(3))) AS h, bool_or(conv_id IS NULL) AND count(conv_id) = 0 AS only_null, min(conv_id) AS conv_id FROM c GROUP BY 1, 2),
keep AS (SELECT conv_id FROM w WHERE (k, h) NOT IN (SELECT (k, h) FROM p)),
parts AS (SELECT c.conv_id, unnest(range(0, (len(rs) - 1) // 1024 + 1)) AS part, rs FROM c JOIN keep ON c.conv_id IS NOT DISTINCT FROM keep.conv_id)
SELECT conv_id, part::BIGINT AS part, len(list_slice(rs, part * 1024 + 1, part * 1024 + 1024))::BIGINT AS n_turns,
  array_to_string(list_slice(rs, part * 1024 + 1, part * 1024 + 1024), '') AS text FROM parts
"""
