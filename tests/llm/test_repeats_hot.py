import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import repeats
from tests.llm.test_repeats import brute_covered


def anchoring(length):
    """A phrase of so many bytes that holds a gram of very small hash, so strings with it take that as anchor."""
    names = [f"Posted by {k:04d}{'.' * (length - 14)}" for k in range(2000)]
    low = [repeats.gram_hashes(np.frombuffer(x.encode() + bytes(16), np.uint8), 12)[:length - 11].min() for x in names]
    return names[int(np.argmin(low))]


def posted(n, phrase, seed=5):
    """Rows that hold a phrase in ever other surroundings, and some that copy others."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        around = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(20, 90))) for _ in range(2)]
        t = phrase.join(around) if i % 3 else "".join(around)
        if i % 7 == 0 and rows:
            t = rng.choice(rows)[1].decode()[rng.randrange(15):]
        rows.append((i, t.encode()))
    return rows


def covered(df, rows, **kw):
    got = repeats.repeated_spans(df, F.col("id"), F.col("data"), **kw).groupBy("id").agg(F.collect_list("span").alias("s")).collect()
    spans = {r.id: repeats.unpack(r.s) for r in got}
    return [{p for a, b in zip(*spans.get(i, ((), ()))) for p in range(a, b)} for i, _ in rows]


@pytest.mark.parametrize("phrase", [anchoring(14), anchoring(30), anchoring(49), "Posted by NAME on DATE in the forum"])
def test_hot_anchors_lose_no_match(spark, monkeypatch, phrase):
    monkeypatch.setattr(repeats, "HOT_BYTES", 4000)
    monkeypatch.setattr(repeats, "SAMPLE", 2)
    monkeypatch.setattr(repeats, "STRETCH", 64)
    rows = posted(260, phrase)
    df = spark.createDataFrame(rows, "id long, data binary")
    assert len(repeats.hot_anchors(df.withColumn("grp", F.lit(0).cast("long")), 50, 12)[0])
    for smaller in (True, False):
        assert covered(df, rows, bucket_bytes=8000, smaller=smaller) == brute_covered(rows, 50, smaller)


def bucket_bytes(rows, n_buckets, block, hot):
    table = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
         pa.array([0] * len(rows), pa.int64()), pa.array([0] * len(rows), pa.int64())], ["id", "data", "grp", "tag"])
    out = np.zeros(n_buckets, np.int64)
    for at in range(0, len(rows), block):
        for batch in repeats.scan([table.slice(at, block)], 50, 12, n_buckets, True, hot):
            for kind, bucket, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "blob"))):
                if kind != 1:
                    out[bucket] += len(repeats.read_blob(blob)[8])
    return out


def test_a_hot_anchor_is_dealt_to_all_buckets(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_BYTES", 20000)
    monkeypatch.setattr(repeats, "SAMPLE", 2)
    monkeypatch.setattr(repeats, "STRETCH", 64)
    rows = posted(2000, anchoring(14))
    df = spark.createDataFrame(rows, "id long, data binary").withColumn("grp", F.lit(0).cast("long"))
    hot, more = repeats.hot_anchors(df, 50, 12)
    assert len(hot) and more > 20000
    whole, dealt = bucket_bytes(rows, 40, 100, np.zeros(0, np.uint64)), bucket_bytes(rows, 40, 100, hot)
    assert whole.max() > 4 * np.median(whole)
    assert dealt.max() < 1.5 * np.median(dealt)
