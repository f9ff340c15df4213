"""Corpus pipeline over ``documents``: quality, near copies, exact passages, test
items, mix. Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.

1. quality classifier: documents likelier bad than good, or toxic than not, go.
2. n-gram Jaccard join on five words at 0.8: of linked documents the one with the
   smallest id stays; a row that repeats another's id and text goes.
3. suffix-array dedup: passages that a smaller id holds are cut out; documents that
   lose their whole text go; n_chars is counted anew.
4. benchmark decontamination: contaminated documents go.
5. mixing sources to target weights: documents are repeated or thinned; this stage
   adds size, source_size, target, copies and copy.

All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.exprs import bounded_broadcast
from quarry.llm import decontaminate, jaccard, mixing, quality_eb, suffix_dedup
from quarry.session import ensure_checkpoint_dir, read_table, ship_package


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = quality_eb.fit(docs, read_table(spark, sf_dir, "labels"))
    judged = quality_eb.quality(docs, model, *quality_eb.site_of_documents())
    return _columns(judged.filter("kept"), docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = jaccard.jaccard_groups(docs, n=5, pct=80)
    linked = found.filter("component_id <> doc_id").select("doc_id").distinct()
    repeated = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    kept = docs.join(bounded_broadcast(linked), "doc_id", "left_anti")
    if repeated.isEmpty():
        return _columns(kept, docs)
    again = bounded_broadcast(repeated)
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return _columns(kept.join(again, "doc_id", "left_anti").unionByName(once), docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    left = suffix_dedup.dedup(docs, with_text=True).filter("n_bytes = 0 OR n_removed < n_bytes")
    return _columns(left.withColumn("n_chars", F.length("text").cast("long")), docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    judged = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return _columns(judged.filter("NOT contaminated"), docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(mixing.mix(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("suffix-array dedup", passages_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources to target weights", mix_stage),
]
#: SQL can't express the fitted classifier; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents``; stages are written to the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
