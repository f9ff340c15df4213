"""Structured Streaming: score an unbounded table with a fitted model.

The reference has no streaming; every fitted model here is a column
expression (or Arrow-batched pandas UDF), so the same ``transform`` applies
to a streaming DataFrame. ``score_stream`` wires readStream -> transform ->
writeStream with a checkpoint on shared storage so a restarted query resumes
exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_stream_like(spark: SparkSession, path: str, like: DataFrame, max_files: int = 1) -> DataFrame:
    """Stream new parquet files in ``path`` with the schema of a batch frame."""
    return (spark.readStream.schema(like.schema).option("maxFilesPerTrigger", max_files).parquet(path))


def score_stream(model, stream: DataFrame, sink_path: str | None, checkpoint: str, query_name: str = "scored",
                 fmt: str = "parquet", trigger_once: bool = True):
    """Apply ``model.transform`` to a stream and start the sink.

    ``fmt='memory'`` keeps results in an in-memory table named
    ``query_name`` (tests); otherwise files are appended under ``sink_path``.
    """
    scored = model.transform(stream)
    w = scored.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    if fmt == "memory":
        return w.format("memory").queryName(query_name).start()
    return w.format(fmt).option("path", sink_path).start()
