"""Operator 10: quality rules with cross-document line frequency.

Per document, inside one row and without a shuffle: word and symbol counts,
repeated lines, and words in three-word windows that occur twice or more (window
hashes are sorted with their positions, so equal ones are neighbours).

Across documents: each distinct normalised line (lower case, one space for white
space, digits as 0) is hashed and counted per host over distinct texts; copies
of one text count once. Lines found in more than ``max_docs`` texts of a host are
boilerplate there. A document that keeps fewer than ``min_words`` words, or less
than ``min_share`` of its words, once they are removed, is rejected.

Defined cases: a null text has no words and fails the base rules; a null host is
a host of its own; lines without a word are no lines; rows that repeat are judged
alike and each is returned; clashing column names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, WORD, key_of, let, need, read_table, without

# Fixed value: the symbols that count.
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
OUT = (*BASE, "n_removed_words", "kept")


def repeat_words(words: Column) -> Column:
    """Number of words inside three-word windows that occur twice or more."""
    def windows(w):
        last = F.greatest(F.size(w) - 2, F.lit(0))
        at = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))))

    def found_again(s):
        n = F.size(s)
        same = lambda i, x: s[i]["h"] == x["h"]
        again = F.filter(s, lambda x, i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), x))
                         | ((i < n - 1) & same(F.least(i + 1, n - 1), x)))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(p):  # the union of [p, p + 3): each adds up to the next start, 3 at most
        n = F.size(p)
        gaps = F.transform(p, lambda x, i: F.when(i == n - 1, 3).otherwise(F.least(p[F.least(i + 1, n - 1)] - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    return let(let(let(words, windows), found_again), covered)


def normalised(line: Column) -> Column:
    one = F.regexp_replace(F.trim(F.translate(line, SPACES, " " * len(SPACES))), " +", " ")
    return F.regexp_replace(F.lower(one), "[0-9]", "0")


def base_rules(docs: DataFrame, min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """All rows and columns of ``docs`` with the columns of BASE."""
    text = F.coalesce(F.col("text"), F.lit(""))
    squeezed = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    d = (without(docs, *BASE)
         .withColumn("word_chars", F.length(squeezed).cast("long"))
         .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
         .withColumn("n_dup_lines", let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")))
         .withColumn("__w", let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
                                lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))))
    d = d.withColumn("n_words", F.col("__w.n")).withColumn("n_repeat_words", F.col("__w.r")).drop("__w")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def line_words(docs: DataFrame, host: Column) -> DataFrame:
    """A row per line with a word: hashes of host, text and normalised line, the
    line's place in its text, and its words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.struct(
        F.xxhash64(normalised(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    return (docs.select(F.xxhash64(key_of(host)).alias("__host"), F.xxhash64(text).alias("__text"),
                        F.posexplode(lines).alias("__pos", "__l"))
            .select("__host", "__text", "__pos", F.col("__l.h").alias("__line"), F.col("__l.n").alias("__words")))


def quality_rules(docs: DataFrame, host: Column | None = None, max_docs: int = 100, min_words: int = 50,
                  min_share: float = 0.5, max_repeat_pct: int = 50) -> DataFrame:
    """Adds the columns of OUT. ``host``: the site of a document (default: source)."""
    need(docs, "doc_id", "text", *(() if host is not None else ("source",)))
    host = F.col("source") if host is None else host
    docs = without(docs, *OUT)
    lines = line_words(docs, host)
    common = (lines.groupBy("__host", "__line", "__text").agg(F.lit(1).alias("__one"))
              .groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("__docs"))
              .filter(F.col("__docs") > max_docs).select("__host", "__line"))
    # a text of a host loses the same words in each of its copies: count one copy
    lost = (lines.join(common, ["__host", "__line"])
            .groupBy("__host", "__text", "__pos").agg(F.max("__words").alias("__words"))
            .groupBy("__host", "__text").agg(F.sum("__words").cast("long").alias("__lost")))
    judged = (base_rules(docs, min_words, max_repeat_pct)
              .withColumn("__host", F.xxhash64(key_of(host)))
              .withColumn("__text", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))))
    d = judged.join(lost, ["__host", "__text"], "left")
    removed = F.coalesce(F.col("__lost"), F.lit(0).cast("long"))
    left = F.col("n_words") - removed
    return (d.withColumn("n_removed_words", removed)
            .withColumn("kept", ~F.col("base_failed") & (left >= min_words) & (left >= min_share * F.col("n_words")))
            .drop("__host", "__text", "__lost"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    d = quality_rules(read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM g),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM h) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
ln AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT r, host, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         regexp_replace(lower(regexp_replace(trim(translate(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')), ' +', ' ', 'g')), '[0-9]', '0', 'g') AS norm
       FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY r),
common AS (SELECT host, norm FROM lw GROUP BY host, norm HAVING count(DISTINCT t) > 100),
lost AS (SELECT r, sum(n) AS n FROM lw JOIN common USING (host, norm) GROUP BY r),
b AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS gone
      FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - gone >= 50 AND n_words - gone >= 0.5::DOUBLE * n_words AS kept FROM f
"""
