"""Operator 9: n-gram Jaccard join with size-banded tiles and bitmap signatures.

A document's set is its distinct word shingles, hashed to 64 bits. Two sets link
when their intersection holds at least ``pct`` percent of their union, so they may
differ in few elements for their size.

1. Equal sets are one node, named by the smallest id that has the set.
2. Candidates: sizes fall into bands a quarter wide. Per band, shingles are dealt by
   hash into one part more than the elements in which two sets of the band may
   differ, so linked sets share at least one whole part. A part's hash is a tile
   key; a set also joins the next band when a partner can be there. A shared empty
   part says nothing: sets with an empty part deal themselves again by other
   hashes, at last by their smallest shingle hashes (a prefix of which linked sets
   share), so no link is lost. Before the shuffle a block of documents keeps one
   document per tile key and links its others to that one, so a key that a third
   of all documents share brings at most one row per block to its bucket. At low
   similarities, where parts would hold few shingles, keys are each set's rarest
   shingles instead (``rare_prefix``).
3. Documents that share a tile key, directly or in a chain, are a candidate group. The
   documents of a group meet as tiles of bounded size: a small group is one tile, a
   large one is cut by size band and hash, and only tiles of compatible sizes are
   compared, so no task ever holds a large group.
4. In a tile, parity bitmaps of the sets are compared in blocks. A bit differs only
   where the sets do, so the count of differing bits bounds the overlap from above.
   Pairs that pass the bound, and aren't connected yet, are intersected exactly.
5. Links found become components by joins (``links``).

Rows of a large candidate group cost a bitmap comparison per compatible pair, in
blocks and without ever being written as pairs.

Defined cases: documents without words, or a null text, have an empty set and link
with nothing; a null id links with nothing and has a null component; rows that share
an id are one document to the links; clashing column names are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import bounded_broadcast
from quarry.llm import rare_prefix
from quarry.llm.common import cut_lineage, need, read_table, tidied, tidy, without
from quarry.llm.links import components
from quarry.llm.textvec import MULT, ascii_lower_table, mix64, portions, ranges, slices, space_word_bytes, span_hashes, word_spans

OUT = ("n_shingles", "component_id")
LEVELS = 3                   # deals by other hashes before the prefix is used
BUCKET_KEYS = 1 << 20        # tile keys per bucket
TILE = 512                   # documents per tile of a large group
BIN_BYTES = 16 << 20         # texts of small groups per task
BROADCAST_ROWS = 1 << 20     # largest id table (16 MB) sent to all tasks


def bands(limit: int = 1 << 40) -> np.ndarray:
    """Lower ends of the size bands: each about a quarter wider than the last."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out)


def shingles(part, begins, ends, n: int = 3):
    """Sorted distinct shingle hashes of each row: (row, hash)."""
    row, start, end = word_spans(part, begins, ends, space_word_bytes())
    if not len(row):
        return row, np.zeros(0, np.uint64)
    h = span_hashes(part, start, end, ascii_lower_table())
    count = np.bincount(row, minlength=len(begins))
    first = np.cumsum(count) - count
    at = ranges(first, np.maximum(count - n + 1, 0))
    acc = np.full(len(at), np.uint64(n))
    for k in range(n):
        acc = mix64(acc * MULT + h[at + k])
    who = row[at]
    short = np.flatnonzero((count > 0) & (count < n))
    for k in range(1, n):  # a text of fewer words is one shingle
        rows = short[count[short] == k]
        one = np.full(len(rows), np.uint64(k))
        for j in range(k):
            one = mix64(one * MULT + h[first[rows] + j])
        who, acc = np.concatenate((who, rows)), np.concatenate((acc, one))
    order = np.lexsort((acc, who))
    who, acc = who[order], acc[order]
    keep = np.concatenate(([True], (who[1:] != who[:-1]) | (acc[1:] != acc[:-1])))
    return who[keep], acc[keep]


def largest_difference(size_sum, pct: int):
    """Most elements in which two sets of this size together may differ."""
    return size_sum * (100 - pct) // (100 + pct)


def tile_keys(who, h, n_rows, edges, pct: int):
    """(row, key): two linked rows share a key. See the module's text."""
    n = np.bincount(who, minlength=n_rows)
    band = np.searchsorted(edges, n, side="right") - 1
    out_row, out_key = [], []
    first = np.cumsum(n) - n
    emptied = np.zeros(n_rows, bool)
    for up in range(3):
        tile = band + up
        joins = (n > 0) & (edges[tile] <= n * 100 // pct) if up else n > 0
        parts = largest_difference(2 * (edges[tile + 1] - 1), pct) + 1
        joins &= parts > 1
        active = joins
        for level in range(LEVELS):
            rows = np.flatnonzero(active)
            if not len(rows):
                break
            m = parts[rows]
            base = np.cumsum(m) - m
            at = ranges(first[rows], n[rows])
            rep = np.repeat(np.arange(len(rows)), n[rows])
            x = h[at]
            place = (((mix64(x + mix64(np.full(1, level + 11, np.uint64))) >> np.uint64(32)) * m[rep].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            slot = base[rep] + place
            order = np.argsort(slot, kind="stable")
            ss = slot[order]
            head = np.flatnonzero(np.concatenate(([True], ss[1:] != ss[:-1])))
            sums = np.add.reduceat(mix64(x[order] ^ np.uint64(0x5851F42D4C957F2D)), head)
            slots = ss[head]
            r = np.searchsorted(base, slots, side="right") - 1
            key = mix64(sums + mix64((slots - base[r]).astype(np.uint64) * np.uint64(8) + np.uint64(level)
                                     + tile[rows][r].astype(np.uint64) * np.uint64(1 << 44)))
            out_row.append(rows[r])
            out_key.append(key)
            filled = np.bincount(r, minlength=len(rows))
            nxt = np.zeros(n_rows, bool)
            nxt[rows[filled < m]] = True
            active = nxt
        emptied |= active
    rows = np.flatnonzero(emptied)
    if len(rows):
        length = n[rows] - (-(-n[rows] * pct // 100)) + 1
        at = ranges(first[rows], length)
        out_row.append(np.repeat(rows, length))
        out_key.append(mix64(h[at] ^ np.uint64(0x2545F4914F6CDD1D)))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_row), np.concatenate(out_key)


def set_keys(who, h, n_rows):
    """Two 64-bit hashes of each row's whole set, zero when it is empty."""
    out = np.zeros((2, n_rows), np.uint64)
    if len(who):
        head = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        for k, salt in enumerate((0x9FB21C651E98DF25, 0xA0761D6478BD642F)):
            out[k, who[head]] = mix64(np.add.reduceat(mix64(h ^ np.uint64(salt)), head))
    return out.view(np.int64)


def signatures(batches, n: int, count: bool = False):
    """doc_id, n_shingles and set keys of every row; with ``count`` also, on the first row
    of each batch, the shingles that many of its documents have."""
    for batch in portions(batches, "data") if count else batches:
        ids = batch.column("doc_id")
        if count:
            yield _counted(batch, ids, n)
            continue
        for a, part, begins, ends in slices(batch.column("data")):
            who, h = shingles(part, begins, ends, n)
            keys = set_keys(who, h, len(begins))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, len(begins)), pa.array(np.bincount(who, minlength=len(begins)), pa.int64()),
                 pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64())], ["doc_id", "n_shingles", "k1", "k2"])


def _counted(batch, ids, n: int) -> pa.RecordBatch:
    size, keys, hashes = [], [], []
    for _, part, begins, ends in slices(batch.column("data")):
        who, h = shingles(part, begins, ends, n)
        size.append(np.bincount(who, minlength=len(begins)))
        keys.append(set_keys(who, h, len(begins)))
        hashes.append(h)
    keys = np.concatenate(keys, axis=1) if keys else np.zeros((2, 0), np.int64)
    many = [rare_prefix.often(hashes)] + [None] * (len(ids) - 1)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.concatenate(size) if size else [], pa.int64()), pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()),
         pa.array(many[:len(ids)], pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "often"])


def _star(key, who):
    """Rows of each key as a star: the first row of every key (sorted by id), and the
    pairs (id, least id of its key) of the others, each once."""
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    hub = who[np.flatnonzero(first)][np.cumsum(first) - 1] if len(key) else who
    other = who != hub
    pairs = np.unique(np.stack((who[other], hub[other]), axis=1), axis=0)
    return key[first], who[first], pairs


def deal_keys(batches, n: int, pct: int, n_buckets: int):
    """Rows (bucket, kind, blob): packed tile keys with a document of the batch that
    has them (kind 0), and links of the batch's other documents to it (kind 1)."""
    edges = bands()
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        got_key, got_id = [], []
        for a, part, begins, ends in slices(batch.column("data")):
            who, h = shingles(part, begins, ends, n)
            row, key = tile_keys(who, h, len(begins), edges, pct)
            got_key.append(key)
            got_id.append(ids[a:a + len(begins)][row].astype(np.int64))
        rows = dealt_rows(np.concatenate(got_key), np.concatenate(got_id), n_buckets)
        for k in range(0, len(rows), 256):
            cols = list(zip(*rows[k:k + 256]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())],
                                             ["bucket", "kind", "blob"])


def dealt_rows(key, who, n_buckets: int) -> list:
    """(bucket, kind, blob) of the keys of some documents, as ``deal_keys`` sends them."""
    packer = zstandard.ZstdCompressor(level=1)
    key, who, pairs = _star(key, who)
    rows = []
    for kind, dealt, data in ((0, (key >> np.uint64(20)) % np.uint64(n_buckets), (key, who)),
                              (1, mix64(pairs[:, 0].view(np.uint64)) % np.uint64(n_buckets), (pairs[:, 0], pairs[:, 1]))):
        order = np.argsort(dealt, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(dealt[order])) + 1, [len(order)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                rows.append((int(dealt[order[a]]), kind, packer.compress(b"".join(x[order[a:b]].tobytes() for x in data))))
    return rows


def shared_keys(table: pa.Table) -> pa.Table:
    """Links (u, v) between documents that share a key of the bucket, as stars."""
    unpacker = zstandard.ZstdDecompressor()
    halves = {0: ([], []), 1: ([], [])}
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
        raw = unpacker.decompress(blob)
        halves[kind][0].append(np.frombuffer(raw, np.int64, len(raw) // 16))
        halves[kind][1].append(np.frombuffer(raw, np.int64, len(raw) // 16, len(raw) // 2))
    u, v = ([np.concatenate(x) for x in halves[1]] if halves[1][0] else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    if halves[0][0]:
        _, _, pairs = _star(np.concatenate(halves[0][0]), np.concatenate(halves[0][1]))
        u, v = np.concatenate((u, pairs[:, 0])), np.concatenate((v, pairs[:, 1]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


# ---------------------------------------------------------------- tiles


def bitmaps(h: np.ndarray, first: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap of each set: bit k tells whether an odd number of its hashes fall
    on k, so two bitmaps differ in no more bits than their sets in elements."""
    rows = np.repeat(np.arange(len(n)), n)
    at = (mix64(h[ranges(first, n)] ^ np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(rows * bits + at, minlength=len(n) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(n), bits), axis=1).view(np.uint64)


def find_links(ids, side, h, n, pct: int, block: int = 64):
    """Links of one tile, as a forest: pairs that connect what wasn't connected.
    ``side``: where both sides occur, only pairs across them are compared."""
    order = np.argsort(n, kind="stable")
    first = (np.cumsum(n) - n)[order]
    ids, side, n = ids[order], side[order], n[order]
    across = side.min() != side.max() if len(side) else False
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(0, len(ids), block):
        b = min(a + block, len(ids))
        top = int(np.searchsorted(n, n[b - 1] * 100 // pct, side="right"))
        if top <= a + 1 or n[b - 1] == 0:
            continue
        most = int(largest_difference(2 * n[top - 1], pct))
        bits = min(4096, max(256, 1 << int(8 * max(most, 1) - 1).bit_length()))
        maps = bitmaps(h, first[a:top], n[a:top], bits)
        for c in range(0, top - a, 512):
            d = min(c + 512, top - a)
            apart = np.bitwise_count(maps[:b - a, None, :] ^ maps[None, c:d, :]).sum(axis=2, dtype=np.int32)
            i, j = np.meshgrid(np.arange(a, b), np.arange(a + c, a + d), indexing="ij")
            fits = (j > i) & (apart <= largest_difference(n[i] + n[j], pct)) & (n[i] > 0)
            if across:
                fits &= side[i] != side[j]
            i, j, apart = i[fits], j[fits], apart[fits]
            for k in np.argsort(apart, kind="stable"):
                x, y = int(i[k]), int(j[k])
                rx, ry = root(x), root(y)
                if rx == ry:
                    continue
                same = len(np.intersect1d(h[first[x]:first[x] + n[x]], h[first[y]:first[y] + n[y]], assume_unique=True))
                if 100 * same >= pct * (int(n[x]) + int(n[y]) - same):
                    parent[max(rx, ry)] = min(rx, ry)
                    if ids[x] != ids[y]:
                        yield int(ids[x]), int(ids[y])


def match_tiles(table: pa.Table, n: int, pct: int) -> pa.Table:
    """Links of all tiles of a task's rows (tile, side, node, data)."""
    table = table.sort_by([("tile", "ascending"), ("node", "ascending")])
    tile = table.column("tile").to_numpy()
    u, v = [], []
    cuts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1]))).tolist() + [len(tile)]
    for a, b in zip(cuts, cuts[1:]):
        part = table.slice(a, b - a)
        sizes, hashes = [], []
        for _, data, begins, ends in slices(part.column("data").combine_chunks()):
            who, h = shingles(data, begins, ends, n)
            sizes.append(np.bincount(who, minlength=len(begins)))
            hashes.append(h)
        for x, y in find_links(part.column("node").to_numpy(), part.column("side").to_numpy(),
                               np.concatenate(hashes), np.concatenate(sizes), pct):
            u.append(x)
            v.append(y)
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _tiles(nodes: DataFrame, pct: int) -> DataFrame:
    """(node, tile, side, task): nodes (node, n_shingles, root) of candidate groups
    dealt to tiles. Groups of up to TILE nodes are a tile; in larger ones each size
    band has as many cells as it needs, and a tile is a pair of cells."""
    edges = bands(1 << 31).tolist()
    sizes = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("g")).filter("g > 1")
    d = nodes.join(sizes, "root")
    small = d.filter(F.col("g") <= TILE).select("node", F.xxhash64("root").alias("tile"), F.lit(0).alias("side"))
    limits = F.array(*[F.lit(int(x)) for x in edges])
    large = d.filter(F.col("g") > TILE).withColumn(
        "band", F.size(F.filter(limits, lambda e: e <= F.col("n_shingles"))) - 1)
    cells = (large.groupBy("root", "band").agg(F.count(F.lit(1)).alias("k"))
             .select("root", "band", F.ceil(F.col("k") / (TILE // 2)).cast("int").alias("cells")))
    large = large.join(cells, ["root", "band"]).withColumn(
        "cell", F.pmod(F.xxhash64("node", F.lit(9)), F.col("cells")).cast("int"))
    lower, upper = F.element_at(limits, F.col("band") + 1), F.element_at(limits, F.col("other") + 1)
    upto = F.element_at(limits, F.col("band") + 2) - 1
    others = cells.select("root", F.col("band").alias("other"), F.col("cells").alias("o_cells"))
    reach = F.transform(F.array(*[F.lit(k) for k in range(-3, 4)]), lambda k: (F.col("band") + k).cast("int"))
    # bands start at 0: the filter below may run before the join, and limits have no place under the first
    pairs = (large.withColumn("other", F.explode(F.filter(reach, lambda b: b >= 0)))
             .join(others, ["root", "other"])
             .filter((F.col("other") == F.col("band"))
                     | ((F.col("other") > F.col("band")) & (upper * pct <= upto * 100))
                     | ((F.col("other") < F.col("band")) & (lower * pct <= (F.element_at(limits, F.col("other") + 2) - 1) * 100)))
             .withColumn("o_cell", F.explode(F.sequence(F.lit(0), F.col("o_cells") - 1))))
    me, it = F.struct("band", "cell"), F.struct(F.col("other").alias("band"), F.col("o_cell").alias("cell"))
    pairs = pairs.select("node", F.xxhash64(F.lit("pair"), "root", F.least(me, it), F.greatest(me, it)).alias("tile"),
                         F.when(me <= it, 0).otherwise(1).alias("side"))
    return small.union(pairs)


def _one_of_each_set(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """``rows`` (doc_id, data) less those of ids that only repeat another document's set."""
    nodes = placed.filter("doc_id = node").select("doc_id").distinct()
    copies = placed.filter("doc_id <> node").select("doc_id").distinct().join(nodes, "doc_id", "left_anti")
    n_copies = copies.count()
    if not n_copies:
        return rows
    if n_copies <= BROADCAST_ROWS:  # counted: 8 bytes a row
        return rows.join(F.broadcast(copies), "doc_id", "left_anti")
    return rows.join(bounded_broadcast(nodes, BROADCAST_ROWS), "doc_id", "left_semi")


def jaccard_groups(docs: DataFrame, n: int = 3, pct: int = 90) -> DataFrame:
    """All rows and columns of ``docs`` with n_shingles and component_id."""
    need(docs, "doc_id", "text")
    rows = without(docs, *OUT)
    raw = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    rare = rare_prefix.needed(pct)
    schema = "doc_id long, n_shingles long, k1 long, k2 long" + ", often binary" * rare
    full = cut_lineage(raw.mapInArrow(lambda it: tidy(signatures(it, n, rare)), schema))
    narrow = full.drop("often")
    known = narrow.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    placed = cut_lineage(narrow.join(nodes, ["k1", "k2"], "left").withColumn(
        "node", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("node"))))

    named = raw.filter("doc_id IS NOT NULL")
    if rare:
        dealt, _ = rare_prefix.prefix_keys(_one_of_each_set(named, placed), full, pct, lambda part, b, e: shingles(part, b, e, n), set_keys, dealt_rows)
    else:
        total = known.agg(F.sum("n_shingles")).first()[0] or 0
        n_buckets = max(1, math.ceil(total / 5 / BUCKET_KEYS))
        dealt = named.mapInArrow(lambda it: tidy(deal_keys(it, n, pct, n_buckets)), "bucket int, kind int, blob binary")
    chain = dealt.groupBy("bucket").applyInArrow(lambda t: tidied(shared_keys(t)), "u long, v long")
    equal = placed.filter("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    roots = components(chain.union(equal))
    roots = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    sizes = placed.filter("doc_id = node").groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    tiles = cut_lineage(_tiles(roots.join(sizes, "node"), pct))
    n_tiles = tiles.count()
    if n_tiles <= BROADCAST_ROWS:  # counted: 24 bytes a row
        tiles = F.broadcast(tiles)
    met = (raw.withColumnRenamed("doc_id", "node").join(tiles, "node")
           .withColumn("task", F.pmod(F.xxhash64("tile"), F.lit(max(1, n_tiles // 2048)))))
    links = met.groupBy("task").applyInArrow(
        lambda t: tidied(match_tiles(t.select(["tile", "side", "node", "data"]), n, pct)), "u long, v long")
    found = components(links)
    out = (placed.join(found.select("node", "root"), "node", "left")
           .select("doc_id", "n_shingles", F.coalesce("root", "node", "doc_id").alias("component_id")))
    return out


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
