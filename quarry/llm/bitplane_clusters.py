"""Operator 12: k-means on integer vectors by bit planes and popcounts.

A vector's components become integers ``floor(scale * x)``. Bit i of all 64 components
(two's complement) is one unsigned 64-bit word, its plane i; planes weigh 1, 2, 4, ...
and the last, the sign, weighs negative. The dot product of a vector and a centroid
is the sum over pairs of planes of weight * weight * popcount(plane AND plane), so
squared distances are exact integers.

Plan: vectors are packed once and written to the shared checkpoint folder (8 bytes a
plane instead of 4 or 8 a component). Each round is one pass that assigns vectors and
sums components per cluster and Arrow batch, then a grouped sum; the driver gets k rows per
component. Component sums come from the planes too. Nothing else is shuffled.

Start: the k vectors with the smallest sha256 of ``<seed>:<id>``; ties by components.

Defined cases: vectors with a null, not finite or missing component, or of another
length, are left out; repeated rows count each; a null id starts a cluster only if
the others don't suffice; fewer than k vectors give as many clusters; an empty table
gives an empty result; columns other than id and vector are not read. Integers of
2**20 or more in size raise an error (distances and their sums must fit 64 bits).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut_lineage, need, read_table

DIM = 64
LIMIT = 1 << 20
BLOCK = 8192


def pack(values: np.ndarray) -> np.ndarray:
    """Planes of integer vectors (rows of 64): as many words a row as the batch needs."""
    top = int(max(values.max(initial=0), -1 - values.min(initial=0)))
    n_planes = top.bit_length() + 1
    planes = np.empty((len(values), n_planes), np.uint64)
    for i in range(n_planes):
        bits = ((values >> i) & 1).astype(np.uint8)
        planes[:, i] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return planes


def weights(n_planes: int) -> list:
    return [1 << i for i in range(n_planes - 1)] + [-(1 << (n_planes - 1))]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows of ``a`` with one packed vector, or row by row."""
    out = np.zeros(len(a), np.int64)
    b = np.atleast_2d(b)
    for i, x in enumerate(weights(a.shape[1])):
        for j, y in enumerate(weights(b.shape[1])):
            out += np.bitwise_count(a[:, i] & b[:, j]).astype(np.int64) * (x * y)
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray):
    """Cluster and squared distance of each packed vector; ties to the smaller number."""
    own = dots(planes, planes)
    packed = pack(centroids)
    best = np.full(len(planes), np.iinfo(np.int64).max)
    which = np.zeros(len(planes), np.int32)
    for c in range(len(packed)):
        far = own + int((centroids[c] ** 2).sum()) - 2 * dots(planes, packed[c])
        closer = far < best
        best[closer], which[closer] = far[closer], c
    return which, best


def cluster_sums(planes: np.ndarray, which: np.ndarray, k: int) -> np.ndarray:
    """Component sums of each cluster."""
    out = np.zeros((k, DIM), np.int64)
    for i, w in enumerate(weights(planes.shape[1])):
        bits = np.unpackbits(np.ascontiguousarray(planes[:, i]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for c in np.unique(which):
            out[c] += bits[which == c].sum(axis=0, dtype=np.int64) * w
    return out


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v): whole vectors of finite components as integers."""
    need(vectors, id_col, vec_col)
    d = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    # NaN is larger than any number in Spark, so it is not below infinity
    d = d.filter((F.size("x") == DIM) & finite)
    return d.select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _packed(ints: DataFrame) -> DataFrame:
    schema = f"id {ints.schema['id'].dataType.simpleString()}, planes binary"

    def run(batches):
        for batch in batches:
            ids, cells = batch.column("id"), batch.column("v")
            for k in range(0, len(ids), BLOCK):
                part = cells.slice(k, BLOCK)
                v = part.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
                if len(v) and (v.max() >= LIMIT or v.min() <= -LIMIT):
                    raise ValueError(f"a component reaches {LIMIT} in size")
                planes = pack(v).astype("<u8")
                raw, width = planes.tobytes(), planes.shape[1] * 8
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(k, BLOCK), pa.array([raw[a:a + width] for a in range(0, len(raw), width)], pa.binary())], ["id", "planes"])
    return ints.mapInArrow(run, schema)


def _blocks(batch: pa.RecordBatch):
    """(rows, planes) of a batch; rows packed with fewer planes go apart."""
    cells = batch.column("planes").to_pylist()
    widths = np.fromiter(map(len, cells), np.int64, len(cells))
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        for k in range(0, len(rows), BLOCK):
            some = rows[k:k + BLOCK]
            yield some, np.frombuffer(b"".join(cells[r] for r in some), "<u8").reshape(len(some), -1).astype(np.uint64)


def _totals(packed: DataFrame, centroids: np.ndarray) -> tuple:
    """Component sums, counts and distance sums of the clusters, as exact integers."""
    k = len(centroids)

    def run(batches):
        for batch in batches:
            for _, planes in _blocks(batch):
                which, far = nearest(planes, centroids)
                table = np.zeros((k, DIM + 2), np.int64)
                table[:, :DIM] = cluster_sums(planes, which, k)
                table[:, DIM] = np.bincount(which, minlength=k)
                np.add.at(table[:, DIM + 1], which, far)
                some = np.flatnonzero(table[:, DIM])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(some, DIM + 2).astype(np.int32)), pa.array(np.tile(np.arange(DIM + 2, dtype=np.int32), len(some))),
                     pa.array(table[some].ravel())], ["cluster", "part", "total"])
    rows = (packed.select("planes").mapInArrow(run, "cluster int, part int, total long")
            .groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    table = [[0] * (DIM + 2) for _ in range(k)]
    for r in rows:
        table[r["cluster"]][r["part"]] = int(r["total"])
    return [t[:DIM] for t in table], [t[DIM] for t in table], [t[DIM + 1] for t in table]


def clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3,
             scale: float = 64.0, seed: int = 1) -> DataFrame:
    """Per whole vector: id, cluster, distance (squared), cluster_inertia, inertia and
    centroid_sha256 (of the final centroid's components joined by commas). ``k`` is at most 1,024."""
    if not 0 < k <= 1024:
        raise ValueError("k lies between 1 and 1024")
    ints = integers(vectors, id_col, vec_col, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = ints.orderBy(key.asc_nulls_last(), "v").limit(k).collect()
    schema = (f"id {ints.schema['id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, "
              "inertia long, centroid_sha256 string")
    if not start:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    centroids = np.array([r["v"] for r in start], np.int64)
    if np.abs(centroids).max() >= LIMIT:
        raise ValueError(f"a component reaches {LIMIT} in size")
    packed = cut_lineage(_packed(ints))
    for _ in range(rounds):
        sums, counts, _ = _totals(packed, centroids)
        centroids = np.array([[s // n for s in row] if n else old.tolist() for row, n, old in zip(sums, counts, centroids)], np.int64)
    _, _, inertia = _totals(packed, centroids)
    each, total = np.array(inertia, np.int64), sum(inertia)
    names = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], object)

    def run(batches):
        for batch in batches:
            which, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for rows, planes in _blocks(batch):
                which[rows], far[rows] = nearest(planes, centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(which), pa.array(far), pa.array(each[which]),
                 pa.array(np.full(len(which), total, np.int64)), pa.array(names[which].tolist(), pa.string())],
                ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return packed.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op12_bitplane_clusters(spark, sf_dir: str) -> DataFrame:
    return clusters(read_table(spark, sf_dir, "embeddings"))


def _twin() -> str:
    """The same in SQL: one block of steps for each round."""
    near = """SELECT vec_id, v, r, c, cv, list_sum(list_transform(range(1, 65), lambda i: (v[i] - cv[i]) * (v[i] - cv[i])))::BIGINT AS far
  FROM kept CROSS JOIN {cents}"""
    pick = """SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min_by(c, far * 1024 + c) AS c, min(far) AS far,
  min_by(cv, far * 1024 + c) AS cv FROM ({near}) GROUP BY r"""
    sql = """WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS c, v AS cv FROM kept
  QUALIFY c < 16)"""
    for k in range(3):
        sql += f""",
a{k} AS MATERIALIZED ({pick.format(near=near.format(cents=f'c{k}'))}),
m{k} AS (SELECT c, list(m ORDER BY i) AS cv FROM (
  SELECT c, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m
  FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{k}) GROUP BY c, i) GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.cv, c{k}.cv) AS cv FROM c{k} LEFT JOIN m{k} USING (c))"""
    return sql + f""",
f AS MATERIALIZED ({pick.format(near=near.format(cents='c3'))})
SELECT vec_id, c::INT AS cluster, far AS distance, (sum(far) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(far) OVER ())::BIGINT AS inertia, sha256(array_to_string(cv, ',')) AS centroid_sha256 FROM f"""


OP12_SQL = _twin()
