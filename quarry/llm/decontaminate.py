"""Operator 2: benchmark decontamination with an Aho-Corasick automaton.

Texts and test items are normalised alike: A-Z to lower case, words of digits,
a-z and characters beyond ASCII, one space between and around them. The windows of
``window`` consecutive words of every item (all words of a shorter one) are the
patterns of one automaton, and each document runs through it once. Found places
are mapped back through word numbers to the original text.

Windows are made by Spark. The automaton goes to every task, so its patterns are
bounded: beyond ``pattern_bytes`` the windows are dealt by hash to as many automata
as needed, each fetched and scanned in turn, with the result so far written to the
shared checkpoint folder in between. Documents never shuffle.

Defined cases: a null text has no words; an item without words has no window; an
item with a null id is named by the empty text; items that share an id are one
item; rows that repeat are judged alike; clashing column names are replaced.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import cut_lineage, need, read_table, tidy, without
from quarry.llm.repeats import merge
from quarry.llm.textvec import word_spans

OUT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hit_spans")
PATTERN_BYTES = 3 << 20  # of one automaton; about a hundred bytes of memory each
HITS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("__words", T.BinaryType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))]


def _tables() -> tuple[bytes, np.ndarray]:
    """Byte map to normalised bytes, and which original bytes are in words."""
    # fixed values: everything in ASCII but digits and letters separates words
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalnum() else 0x20
    return bytes(out), np.frombuffer(bytes(out), np.uint8) != 0x20


FOLD, INSIDE = _tables()


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def windows_of(words: list[bytes], window: int) -> list[bytes]:
    if not words:
        return []
    n = min(window, len(words))
    return [b" " + b" ".join(words[k:k + n]) + b" " for k in range(len(words) - n + 1)]


def benchmark_windows(items: DataFrame, window: int, n_groups: int) -> DataFrame:
    """(pattern, grp, item) of every item's windows."""
    need(items, "item_id", "text")
    d = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                     F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))

    def cut(batches):
        for batch in batches:
            rows = [(p, zlib.crc32(p) % n_groups, item)
                    for item, raw in zip(batch.column("item").to_pylist(), batch.column("data").to_pylist())
                    for p in set(windows_of(words_of(raw), window))]
            for k in range(0, len(rows), 4096):
                cols = list(zip(*rows[k:k + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())],
                                                 ["pattern", "grp", "item"])
    return d.mapInArrow(cut, "pattern binary, grp int, item string").distinct()


_AUTOMATA: dict = {}


def automaton(patterns: list[tuple[bytes, list[str]]], name: str):
    """The automaton of this process; the last one made is kept for later tasks."""
    if name not in _AUTOMATA:
        import ahocorasick
        a = ahocorasick.Automaton()
        for p, items in patterns:
            a.add_word(p.decode("latin-1"), (len(p), p.count(b" ") - 1, items))
        a.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[name] = a
    return _AUTOMATA[name]


def original_spans(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Character offsets in the original text of runs of word numbers."""
    data = np.frombuffer(raw, np.uint8)
    _, first, last = word_spans(data, np.zeros(1, np.int64), np.array([len(data)]), INSIDE)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [{"start": int(chars[first[a]]), "end": int(chars[last[b - 1]])} for a, b in zip(starts, ends)]


def find_hits(raw: bytes, scanner):
    """Number of words, hit runs of word numbers, and items of one text."""
    words = words_of(raw)
    if not words or scanner is None:
        return len(words), None, None
    text = b" " + b" ".join(words) + b" "
    starts, counts, items = [], [], set()
    for end, (length, n, found) in scanner.iter(text.decode("latin-1")):
        starts.append(end - length + 1)
        counts.append(n)
        items.update(found)
    if not starts:
        return len(words), None, None
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    first = np.searchsorted(spaces, np.array(starts))
    return len(words), merge(first, first + np.array(counts)), items


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, min_hit_pct: int = 5,
                  pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with the columns of OUT. A document is
    contaminated if its hit words are at least ``min_hit_pct`` percent of its words."""
    need(docs, "text")
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_groups = max(1, math.ceil(size * window / pattern_bytes))
    patterns = benchmark_windows(items, window, n_groups)
    patterns = cut_lineage(patterns) if n_groups > 1 else patterns
    d = without(docs, *OUT)
    own = d.columns
    d = d.withColumn("__raw", F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    for f in HITS:
        d = d.withColumn(f.name, F.lit(None).cast(f.dataType))
    for g in range(n_groups):
        rows = patterns.filter(F.col("grp") == g).groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items")).collect()
        rows = [(bytes(r["pattern"]), r["items"]) for r in rows]
        # the groups' mean is below the limit; a group far above it means hash trouble
        if sum(len(p) for p, _ in rows) > 4 * pattern_bytes:
            raise ValueError("a group of benchmark windows is too large for one automaton")
        name = hashlib.sha256(repr(sorted(rows)).encode()).hexdigest()
        sent = spark.sparkContext.broadcast(rows)
        scan = _scan(sent, name)
        d = d.mapInArrow(lambda it, scan=scan: tidy(scan(it)), d.schema)
        if g + 1 < n_groups:
            d = cut_lineage(d)
    n_hit = F.col("n_hit")
    d = (d.withColumn("n_items", F.size("items").cast("long"))
         .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
         .withColumn("contaminated", (n_hit > 0) & (100 * n_hit >= min_hit_pct * F.col("n_words"))))
    return d.select(*[F.col(f"`{c}`") for c in own], *OUT)


def len_of(packed: bytes) -> int:
    """Words in packed runs."""
    pairs = np.frombuffer(packed, ">i4").reshape(-1, 2)
    return int((pairs[:, 1] - pairs[:, 0]).sum())


def _scan(sent, name):
    def run(batches):
        scanner = automaton(sent.value, name) if sent.value else None
        for batch in batches:
            names = batch.schema.names
            out = {f.name: [] for f in HITS}
            before = zip(batch.column("__words").to_pylist(), batch.column("items").to_pylist(), batch.column("hit_spans").to_pylist())
            for cell, (words, items, spans) in zip(batch.column("__raw"), before):
                raw = cell.as_py()
                n, runs, found = find_hits(raw, scanner)
                if words is None:
                    words, items, spans = b"", [], []
                if runs is not None:
                    old = np.frombuffer(words, ">i4").reshape(-1, 2).astype(np.int64)
                    s, e = merge(np.concatenate((old[:, 0], runs[0])), np.concatenate((old[:, 1], runs[1])))
                    words = np.column_stack((s, e)).astype(">i4").tobytes()
                    items, spans = sorted(found.union(items)), original_spans(raw, s, e)
                for key, value in zip(out, (n, len_of(words), words, items, spans)):
                    out[key].append(value)
            kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "__words": pa.binary(), "items": pa.list_(pa.string()),
                     "hit_spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], kinds[c]) if c in out else batch.column(c) for c in names], names)
    return run


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    d = contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS w
  FROM (SELECT item, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS w
  FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d JOIN ks ON len(ws) >= k)),
hits AS (SELECT r, dw.k, i, item FROM dw JOIN bw ON dw.k = bw.k AND dw.w = bw.w),
nh AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
ni AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(nh.n, 0)::BIGINT AS n_hit, coalesce(ni.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(nh.n, 0) > 0 AND 20 * coalesce(nh.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN nh USING (r) LEFT JOIN ni USING (r)
"""
