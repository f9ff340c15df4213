"""Candidate pairs of the n-gram Jaccard join at low similarities: rare prefixes.

Where linked sets may differ in a fifth of their elements, the parts of ``tile_keys``
would be too small to be told apart, so keys are single shingles. Order all shingles
by document frequency, rarest first (ties by hash). Two linked sets share one of their
first ``n - ceil(pct * n) + 1`` shingles in this order, so those are a set's keys;
common phrases come last and are hardly ever keys.

1. Shingles go to buckets by hash with their document's id, packed and compressed. One
   document is sent for each distinct set (the caller's ``raw``, and each batch, see to that).
2. A bucket counts documents per shingle. Shingles of one document can't be shared;
   the others return to their documents' buckets with their frequency.
3. A document of which fewer than ``ceil(pct * n)`` shingles are shared links with
   nothing. The others send their keys, less those that are in one document.

Very frequent shingles (one in ``HOT`` documents, found by counts per batch; a table
of at most ``HOT_ROWS`` rows) don't go through step 1: they are the end of the order. So
no bucket holds the rows of a shingle that a large share of all documents has.

Rows that share an id but not a text are one document to the links: their keys are
all their shared shingles, which covers the keys of each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import tidied, tidy
from quarry.llm.textvec import mix64, portions, slices

LOAD = 6                  # fewer shingles than this in a part: prefixes instead
HOT = 1000
HOT_ROWS = 1 << 20
LEAST = 64
OFTEN = 8                 # documents of a batch that make a shingle worth counting
BUCKET_ROWS = 1 << 20     # shingles per bucket
_LOW = np.uint64((1 << 40) - 1)


def needed(pct: int) -> bool:
    """Whether parts of the size bands would hold too few shingles."""
    return 100 + pct < LOAD * 250 * (100 - pct) / 100


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit values of one length, byte plane by byte plane, compressed."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blobs: list, n_arrays: int) -> list[np.ndarray]:
    """The arrays of several packed blobs, one after the other, as uint64."""
    unpacker = zstandard.ZstdDecompressor()
    parts = [[] for _ in range(n_arrays)]
    for blob in blobs:
        raw = np.frombuffer(unpacker.decompress(blob), np.uint8).reshape(n_arrays, 8, -1)
        for k in range(n_arrays):
            parts[k].append(np.ascontiguousarray(raw[k].T).view(np.uint64).ravel())
    return [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts]


def often(hashes: list) -> bytes | None:
    """Packed (hash, count) of the shingles that many documents of a batch have."""
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    slot = (h >> np.uint64(42)).astype(np.int64)
    h = h[np.bincount(slot, minlength=1 << 22)[slot] >= OFTEN]
    if not len(h):
        return None
    found, n = np.unique(h, return_counts=True)
    keep = n >= OFTEN
    return pack(found[keep], n[keep].astype(np.uint64)) if keep.any() else None


def hot_shingles(narrow: DataFrame, n_docs: int, n_shingles: int) -> np.ndarray:
    """Sorted hashes of the very frequent shingles, from the batches' ``often`` column."""
    least = max(LEAST, n_docs // HOT, math.ceil(n_shingles / HOT_ROWS))

    def run(batches):
        for batch in batches:
            h, n = unpack([b for b in batch.column("often").to_pylist() if b], 2)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.view(np.int64))], ["h", "n"])
    rows = (narrow.filter("often IS NOT NULL").select("often").mapInArrow(run, "h long, n long")
            .groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h"))
    return np.sort(np.array([r["h"] for r in rows.collect()], np.int64).view(np.uint64))  # n_shingles / least rows at most


def _rows(bucket: np.ndarray, kind: int, *arrays: np.ndarray):
    """(bucket, kind, blob) of rows dealt to buckets."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = order[a:b]
        yield int(bucket[a]), kind, pack(*[x[at] for x in arrays])


def _batches(rows: list):
    for k in range(0, len(rows), 64):
        cols = list(zip(*rows[k:k + 64]))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())],
                                         ["bucket", "kind", "blob"])


def _table(rows: list) -> pa.Table:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.table({"bucket": pa.array(cols[0], pa.int32()), "kind": pa.array(cols[1], pa.int32()), "blob": pa.array(cols[2], pa.binary())})


def _deal_ids(ids: np.ndarray, n_buckets: int) -> np.ndarray:
    return mix64(ids) % np.uint64(n_buckets)


def posts(batches, shingles, set_keys, hot: np.ndarray, n_buckets: int):
    """Step 1. Kind 0: (shingle, id) in the shingle's bucket. Kind 1, in the id's
    bucket: (id, number of shingles, number of very frequent ones). Kind 2: (id, hash)
    of the very frequent ones."""
    for batch in portions(batches, "data"):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        at, hs, sets = [], [], []
        for a, part, begins, ends in slices(batch.column("data")):
            who, h = shingles(part, begins, ends)
            at.append(who + a)
            hs.append(h)
            sets.append(set_keys(who, h, len(begins)))
        if not at:
            continue
        at, h, sets = np.concatenate(at), np.concatenate(hs), np.concatenate(sets, axis=1)
        n = np.bincount(at, minlength=len(ids))
        first = np.zeros(len(ids), bool)
        first[np.unique(sets, axis=1, return_index=True)[1]] = True
        # a repeated id keeps all its rows
        twice = np.unique(ids, return_inverse=True, return_counts=True)
        first |= twice[2][twice[1]] > 1
        first &= n > 0
        keep = first[at]
        at, h = at[keep], h[keep]
        place = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
        is_hot = hot[place] == h if len(hot) else np.zeros(len(h), bool)
        z = np.bincount(at[is_hot], minlength=len(ids))
        cold, who = h[~is_hot], ids[at[~is_hot]]
        order = np.argsort(cold & _LOW, kind="stable")
        cold, who = cold[order], who[order]
        rows = list(_rows((cold >> np.uint64(40)) % np.uint64(n_buckets), 0, cold & _LOW, who))
        own = ids[first]
        rows += _rows(_deal_ids(own, n_buckets), 1, own, n[first].astype(np.uint64), z[first].astype(np.uint64))
        many = ids[at[is_hot]]
        rows += _rows(_deal_ids(many, n_buckets), 2, many, h[is_hot])
        yield from _batches(rows)


def _by_kind(table: pa.Table) -> dict:
    out = {0: [], 1: [], 2: []}
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
        out[kind].append(blob)
    return out


def shared(table: pa.Table, n_buckets: int) -> pa.Table:
    """Step 2: kind 0 becomes (id, shingle, frequency) in the id's bucket; others pass."""
    bucket = table.column("bucket")[0].as_py()
    kinds = _by_kind(table)
    rows = [(bucket, k, blob) for k in (1, 2) for blob in kinds[k]]
    value, who = unpack(kinds[0], 2)
    order = np.lexsort((who, value))
    value, who = value[order], who[order]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (who[1:] != who[:-1]))) if len(value) else np.zeros(0, bool)
    value, who = value[new], who[new]
    if len(value):
        head = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        df = np.repeat(np.diff(np.append(head, len(value))), np.diff(np.append(head, len(value))))
        keep = df > 1
        value, who, df = value[keep], who[keep], df[keep].astype(np.uint64)
        rows += _rows(_deal_ids(who, n_buckets), 0, who, value | np.uint64(bucket << 40), df)
    return _table(rows)


def keys(table: pa.Table, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Step 3: (key, id) of the documents of a bucket that can link."""
    kinds = _by_kind(table)
    who, key, df = unpack(kinds[0], 3)
    own, n, z = (a.view(np.int64) for a in unpack(kinds[1], 3))
    hot_id, hot_hash = unpack(kinds[2], 2)
    ids, first, times = np.unique(own, return_index=True, return_counts=True)
    n, z = n[first], z[first]

    def ranked(id_, *by):
        order = np.lexsort((*by[::-1], id_))
        id_ = id_[order]
        return order, np.searchsorted(ids, id_), np.arange(len(id_)) - np.searchsorted(id_, id_)
    # an id's rows of one shingle: each batch may have sent its own, and a frequent one too
    pair = np.unique(np.stack((hot_id, hot_hash)), axis=1) if len(hot_id) else np.zeros((2, 0), np.uint64)
    hot_id, hot_hash = pair
    c = np.bincount(np.searchsorted(ids, who.view(np.int64)), minlength=len(ids))
    least = -(-n * pct // 100)
    limit = c + z - least + 1  # of the shingles in two documents or more
    limit = np.where(limit > 0, limit, 0)
    limit = np.where(times > 1, np.iinfo(np.int64).max, limit)
    order, doc, rank = ranked(who.view(np.int64), df, key)
    take = rank < limit[doc]
    out_key, out_id = [mix64(key[order][take])], [who[order][take]]
    order, doc, rank = ranked(hot_id.view(np.int64), hot_hash)
    take = rank < np.where(times > 1, limit, limit - c)[doc]
    out_key.append(mix64(hot_hash[order][take] ^ np.uint64(0x2545F4914F6CDD1D)))
    out_id.append(hot_id[order][take])
    return np.concatenate(out_key), np.concatenate(out_id).view(np.int64)


def prefix_keys(raw: DataFrame, narrow: DataFrame, pct: int, shingles, set_keys, deal) -> tuple[DataFrame, int]:
    """Rows (bucket, kind, blob) of keys as ``deal(key, id, n_buckets)`` packs them, and the number
    of buckets. ``raw``: (doc_id, data); ``narrow``: n_shingles and often of all rows."""
    size = narrow.agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s")).first()
    total = size["s"] or 0
    hot = raw.sparkSession.sparkContext.broadcast(hot_shingles(narrow, size["n"], total))
    n_buckets = max(1, math.ceil(total / BUCKET_ROWS))
    schema = "bucket int, kind int, blob binary"

    def prefixes(table: pa.Table) -> pa.Table:
        return _table(deal(*keys(table, pct), n_buckets))
    rows = (raw.mapInArrow(lambda it: tidy(posts(it, shingles, set_keys, hot.value, n_buckets)), schema)
            .groupBy("bucket").applyInArrow(lambda t: tidied(shared(t, n_buckets)), schema)
            .groupBy("bucket").applyInArrow(lambda t: tidied(prefixes(t)), schema))
    return rows, n_buckets
