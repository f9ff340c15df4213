"""Operator 5: suffix-array dedup of exact passages.

Every byte covered by a string of ``window`` bytes that also starts in a document
with a smaller id goes; overlaps count, and strings are judged on the input. The
strings come from two-stage suffix sorting (``repeats``, ``suffix``); the spans of
a document are merged and its remaining bytes joined.

Defined cases: a null text has no bytes; documents with a null id keep everything
and take nothing from others; documents that share an id never take from each
other; rows that repeat are returned once each; a cut may split a character, so
the remaining text is offered as bytes, and as text with broken characters
dropped; clashing column names are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import need, read_table, tidy, without
from quarry.llm.repeats import repeated_spans, unpack

OUT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def kept_parts(raw: bytes, blobs) -> tuple[bytes, int]:
    starts, ends = unpack(blobs)
    if not len(starts):
        return raw, 0
    edges = np.concatenate(([0], np.column_stack((starts, ends)).ravel(), [len(raw)])).tolist()
    return b"".join(raw[edges[k]:edges[k + 1]] for k in range(0, len(edges), 2)), len(starts)


def _packed(d: DataFrame) -> DataFrame:
    """``d`` with compressed bytes in place of the text: texts cross the shuffle once,
    and that is most of what this operator moves."""
    d = d.withColumn("__null", F.col("text").isNull()).drop("text")
    names, at = d.columns, d.columns.index("__raw")

    def run(batches):
        packer = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            packed = pa.array([packer.compress(x.as_py()) for x in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if k == at else batch.column(k) for k in range(batch.num_columns)], names)
    return d.mapInArrow(lambda it: tidy(run(it)), d.schema)


def dedup(docs: DataFrame, window: int = 50, with_text: bool = False) -> DataFrame:
    """All rows of ``docs`` with the columns of OUT. ``with_text``: ``text`` becomes
    what is left of it; otherwise the text column is dropped."""
    need(docs, "doc_id", "text")
    d = without(docs, *OUT)
    spans = (repeated_spans(d, F.col("doc_id"), F.col("text"), window=window)
             .groupBy("id", "tag").agg(F.collect_list("span").alias("__spans")))
    rest = [c for c in d.columns if c.lower() != "text"]
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    left = d.withColumn("__raw", raw).withColumn("__tag", F.xxhash64("__raw"))  # hashed before it is packed
    joined = (_packed(left).join(spans, (F.col("doc_id").cast("long") == F.col("id")) & ((F.col("tag") == 0) | (F.col("tag") == F.col("__tag"))), "left")
              .select(*[F.col(f"`{c}`") for c in d.columns if c.lower() != "text"],
                      "__null", "__raw", "__spans"))
    fields = [joined.schema[c] for c in joined.columns if c not in ("__null", "__raw", "__spans")]
    fields += [T.StructField("text", T.StringType())] if with_text else []
    fields += [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
               T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]

    def cut(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            keep = [batch.column(k) for k in range(len(rest))]
            kept, sizes, counts = [], [], []
            for raw, blobs in zip(batch.column("__raw"), batch.column("__spans").to_pylist()):
                raw = unpacker.decompress(raw.as_py())
                left, n = kept_parts(raw, blobs or ())
                kept.append(left)
                sizes.append(len(raw))
                counts.append(n)
            digests = [hashlib.sha256(x).hexdigest() for x in kept]
            gone = [a - len(b) for a, b in zip(sizes, kept)]
            if with_text:
                nulls = batch.column("__null").to_pylist()
                keep.append(pa.array([None if z else x.decode("utf-8", "ignore") for z, x in zip(nulls, kept)], pa.string()))
            keep += [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(keep, [f.name for f in fields])

    return joined.mapInArrow(lambda it: tidy(cut(it)), T.StructType(fields))


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
