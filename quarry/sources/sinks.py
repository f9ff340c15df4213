"""Sinks (S10-S17, S19): every report sheet is a DataFrame written as
parquet (or CSV) under a run directory on shared storage; fitted models are
JSON documents written through Spark so any executor/driver can reload them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def write_sheets(sheets: dict[str, DataFrame], run_dir: str, fmt: str = "parquet") -> dict[str, str]:
    """One folder per sheet (report workbook equivalent)."""
    out = {}
    for name, df in sheets.items():
        path = f"{run_dir.rstrip('/')}/{name}"
        w = df.write.mode("overwrite")
        (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
        out[name] = path
    return out


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Input columns + Predicted_* columns."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
    return path


def write_json_doc(spark: SparkSession, doc: dict, path: str) -> str:
    """A small JSON document (summary, fitted parameters) via Spark."""
    spark.createDataFrame([(json.dumps(doc),)], "doc string").coalesce(1).write.mode("overwrite").text(path)
    return path


def read_json_doc(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def downsample_evenly(df: DataFrame, order_cols: list[str], n_keep: int = 500) -> DataFrame:
    """Keep positions floor(i*(n-1)/(n_keep-1)) of the ordered rows.

    Ranks come from the distributed prefix-count helper (no single-task
    window over the table); the kept positions are a broadcast table of at
    most ``n_keep`` rows.
    """
    from quarry.functions.exprs import key_hash
    n = df.count()
    if n <= n_keep:
        return df
    keep = sorted({(i * (n - 1)) // (n_keep - 1) for i in range(n_keep)})
    spark = df.sparkSession
    h = key_hash("order", order_cols)
    ranked = _distributed_rank(df.withColumn("__h", h), "__h")
    pos = spark.createDataFrame([(int(p),) for p in keep], "__pos long")  # n_keep rows
    return ranked.join(F.broadcast(pos), ranked["__rank"] == pos["__pos"]).drop("__h", "__rank", "__pos")


def _distributed_rank(df: DataFrame, key: str) -> DataFrame:
    """0-based rank by a unique hex-hash key: bucket on its leading digits,
    broadcast bucket offsets, row_number inside buckets."""
    from quarry.functions.exprs import hash_bucket
    b = df.withColumn("__b", hash_bucket(F.col(key), 4))
    counts = sorted((r["__b"], r["count"]) for r in b.groupBy("__b").count().collect())  # <= 65,536 rows
    offs, acc = [], 0
    for bb, c in counts:
        offs.append((bb, acc))
        acc += c
    off = df.sparkSession.createDataFrame(offs, "__b int, __off long")
    w = Window.partitionBy("__b").orderBy(key)
    return (b.join(F.broadcast(off), "__b")
            .withColumn("__rank", F.col("__off") + F.row_number().over(w) - 1).drop("__b", "__off"))


def _plain(v):
    """Arrays and tuples as marked JSON values, so that they come back as they were."""
    import numpy as np
    if isinstance(v, np.ndarray):
        return {"__array": v.tolist()}
    if isinstance(v, np.generic):
        return v.item()
    if isinstance(v, tuple):
        return {"__tuple": [_plain(x) for x in v]}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {"__dict": [[_plain(k), _plain(x)] for k, x in v.items()]}
    return v


def _restored(v):
    import numpy as np
    if isinstance(v, list):
        return [_restored(x) for x in v]
    if isinstance(v, dict):
        (kind, x), = v.items()
        return {"__array": lambda: np.array(x), "__tuple": lambda: tuple(map(_restored, x)),
                "__dict": lambda: {_restored(a): _restored(b) for a, b in x}}[kind]()
    return v


def save_model(spark: SparkSession, model, path: str) -> str:
    """Persist a fitted model for later scoring.

    Spark ML models use their own writer. Other models are dataclasses: their fields go
    to a small JSON document, a field that is a table (the rows of neighbour models) to
    parquet, and fields that are models, or lists of them, to folders of their own.
    """
    import dataclasses
    inner = getattr(model, "model", None)
    if inner is not None and hasattr(inner, "write"):
        inner.write().overwrite().save(f"{path}/spark_model")
        meta = {"kind": "spark", "module": type(inner).__module__, "class": type(inner).__name__, "features": model.features,
                "classes": model.classes}
        return write_json_doc(spark, meta, f"{path}/meta")
    if not dataclasses.is_dataclass(model) or not type(model).__module__.startswith("quarry."):
        raise TypeError(f"cannot save {type(model).__name__}")

    def is_model(v):
        return dataclasses.is_dataclass(v) and not isinstance(v, type)
    doc = {"kind": "fields", "module": type(model).__module__, "class": type(model).__name__, "fields": {}, "tables": [], "models": {}}
    for f in dataclasses.fields(model):
        v = getattr(model, f.name)
        if isinstance(v, DataFrame):
            v.write.mode("overwrite").parquet(f"{path}/{f.name}")
            doc["tables"].append(f.name)
        elif is_model(v) or isinstance(v, list) and v and all(map(is_model, v)):
            for i, part in enumerate(v if isinstance(v, list) else [v]):
                save_model(spark, part, f"{path}/{f.name}/{i}")
            doc["models"][f.name] = len(v) if isinstance(v, list) else None
        else:
            doc["fields"][f.name] = _plain(v)
    return write_json_doc(spark, doc, f"{path}/meta")


def load_model(spark: SparkSession, path: str):
    """Inverse of ``save_model``; only classes of this library and of Spark ML are made."""
    import importlib
    meta = read_json_doc(spark, f"{path}/meta")
    if not meta["module"].startswith(("quarry.", "pyspark.ml.")):
        raise TypeError(f"{meta['module']} holds no model of this library")
    cls = getattr(importlib.import_module(meta["module"]), meta["class"])
    if meta["kind"] == "spark":
        from quarry.operators.native import FittedSpark
        return FittedSpark(cls.load(f"{path}/spark_model"), meta["features"], meta["classes"])
    fields = {k: _restored(v) for k, v in meta["fields"].items()}
    fields.update({t: spark.read.parquet(f"{path}/{t}") for t in meta["tables"]})
    for name, n in meta["models"].items():
        parts = [load_model(spark, f"{path}/{name}/{i}") for i in range(1 if n is None else n)]
        fields[name] = parts[0] if n is None else parts
    return cls(**fields)
