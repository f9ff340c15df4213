"""Operator 11: byte-level BPE encoding and decoding with a segment tree.

A text is split into pieces by the tokenizer's pattern, and each piece is encoded by
itself: a piece that is a token is that token, any other starts as its bytes. The
leaves of a segment tree over the byte positions hold ``rank * size + position`` of
the pair that begins there, so the root is the leftmost pair of least rank. A merge
rewrites three leaves (the merged token's, the one it swallowed and its left
neighbour's, found by links to the live neighbours) and their ancestors: a
logarithmic number of updates. Pieces of up to ``WIDE`` bytes are merged many at a
time, a tree per row of a numpy array; longer ones one by one.

Decoding joins the bytes of the tokens.

No shuffle: one ``mapInArrow`` over the rows. The ranks are read on the driver from
a path and broadcast (the file's size is checked against ``max_file``). A Python
worker remembers the ids of at most ``KEPT`` short pieces and works on stretches of
about ``STRETCH`` characters.

Defined cases: a null text is empty; an empty text has no tokens; a very long text is
cut into stretches before a space that follows a non-space, where a piece always
ends; a very long piece takes memory in proportion to its bytes; rows that repeat are
encoded alike; an empty table gives an empty result; columns of the input named like
an output are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import need, read_table, without

OUT = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
WIDE = 128            # bytes of the longest piece merged in numpy rows
KEPT = 200_000        # pieces remembered by a worker
STRETCH = 1 << 20     # characters worked on at a time
MAX_FILE = 64 << 20
INF = np.iinfo(np.int64).max


@dataclass
class Ranks:
    """A vocabulary: tokens by id, ids by token, and the pairs that merge."""
    tokens: list
    ids: dict
    byte_ids: np.ndarray
    pairs: np.ndarray     # sorted: left id * 2**32 + right id
    merged: np.ndarray    # id of each pair's joined bytes

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the joined tokens; -1 where that is no token or one side is -1."""
        key = (left << 32) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.merged[at], -1)


def make_ranks(ids: dict) -> Ranks:
    """Ranks from (token bytes -> id); every single byte has to be a token."""
    lacking = [b for b in range(256) if bytes([b]) not in ids]
    if lacking:
        raise ValueError(f"{len(lacking)} single bytes are no tokens")
    tokens = [b""] * (max(ids.values()) + 1)
    pairs = {}
    for token, i in ids.items():
        tokens[i] = token
        for cut in range(1, len(token)):
            left, right = ids.get(token[:cut]), ids.get(token[cut:])
            if left is not None and right is not None:
                pairs[(left << 32) + right] = i
    keys = np.array(sorted(pairs) or [-1], np.int64)
    return Ranks(tokens, ids, np.array([ids[bytes([b])] for b in range(256)], np.int64), keys,
                 np.array([pairs.get(int(k), -1) for k in keys], np.int64))


def read_ranks(path: str, max_file: int = MAX_FILE) -> Ranks:
    """A rank file: lines of base64 token and id. Larger files than ``max_file`` raise."""
    if os.path.getsize(path) > max_file:
        raise ValueError(f"rank file {path} is larger than {max_file} bytes")
    with open(path, "rb") as f:
        return make_ranks({base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())})


def merge_many(pieces: list, size: int, ranks: Ranks) -> list:
    """Ids of pieces of 1 to ``size`` bytes (a power of two), as packed bytes."""
    n, row = len(pieces), size + 1
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    data = np.frombuffer(b"".join(p.ljust(row, b"\0") for p in pieces), np.uint8).reshape(n, row)
    column = np.arange(row)
    # one spare column ends each row: the neighbour of the last and (as index -1) of the first token
    token = np.where(column < lengths[:, None], ranks.byte_ids[data], -1)
    after = np.minimum(np.broadcast_to(column + 1, (n, row)), lengths[:, None])
    after = np.where(after >= lengths[:, None], size, after)
    before = np.broadcast_to(column - 1, (n, row)).copy()
    tree = np.full((n, 2 * size), INF)
    first = ranks.pair(token[:, :-1], token[:, 1:])
    tree[:, size:] = np.where(first >= 0, first * size + column[:-1], INF)
    level = size
    while level > 1:
        level //= 2
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
    token, after, before, tree = token.ravel(), after.ravel(), before.ravel(), tree.ravel()
    rows = np.arange(n)
    while True:
        root = tree[rows * 2 * size + 1]
        rows, root = rows[root < INF], root[root < INF]
        if not len(rows):
            break
        base, at, joined = rows * row, root % size, root // size
        gone = after[base + at]
        right = after[base + gone]
        token[base + at], token[base + gone] = joined, -1
        after[base + at] = right
        before[base + right] = at
        left = before[base + at]
        has_left = left >= 0
        new_at = ranks.pair(joined, token[base + right])
        new_left = ranks.pair(token[base + np.where(has_left, left, size)], joined)
        node = np.stack([gone, at, np.where(has_left, left, gone)]) + size
        value = np.stack([np.full(len(rows), INF), np.where(new_at >= 0, new_at * size + at, INF),
                          np.where(new_left >= 0, new_left * size + left, INF)])
        base = rows * 2 * size
        tree[base + node] = value
        while node[0, 0] > 1:
            node >>= 1
            tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])
    live = token.reshape(n, row) >= 0
    flat = token[live.ravel()].astype("<u4").tobytes()
    ends = np.cumsum(live.sum(axis=1)) * 4
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def merge_one(piece: bytes, ranks: Ranks) -> bytes:
    """Ids of one piece of any length, as packed bytes."""
    size = 1 << max(len(piece) - 1, 1).bit_length()
    token = [int(ranks.byte_ids[b]) for b in piece]
    tokens, ids, end = ranks.tokens, ranks.ids, len(piece)
    after, before = list(range(1, end + 1)), list(range(-1, end))
    none = 1 << 62

    def leaf(a, b):
        rank = ids.get(tokens[token[a]] + tokens[token[b]]) if a >= 0 and b < end else None
        return none if rank is None else rank * size + a

    tree = [none] * (2 * size)
    tree[size:size + end] = [leaf(a, a + 1) for a in range(end)]
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while tree[1] < none:
        rank, at = divmod(tree[1], size)
        gone = after[at]
        right = after[gone] if gone < end else end
        token[at], token[gone], after[at] = rank, -1, right
        before[right] = at
        left = before[at]
        for place, value in ((gone, none), (at, leaf(at, right)), (left, leaf(left, at))):
            if place < 0:
                continue
            node = place + size
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low
    found = [t for t in token if t >= 0]
    return struct.pack(f"<{len(found)}I", *found)


def merge_pieces(pieces: list, ranks: Ranks) -> dict:
    """Packed ids of distinct pieces."""
    out, by_size = {}, {}
    for text in pieces:
        raw = text.encode()
        whole = ranks.ids.get(raw)
        if whole is not None:
            out[text] = struct.pack("<I", whole)
        elif len(raw) > WIDE:
            out[text] = merge_one(raw, ranks)
        else:
            by_size.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((text, raw))
    for size, group in by_size.items():
        step = max(1, (1 << 17) // size)
        for k in range(0, len(group), step):
            names, raws = zip(*group[k:k + step])
            out.update(zip(names, merge_many(raws, size, ranks)))
    return out


class Coder:
    """Encodes and decodes texts in one Python worker."""

    def __init__(self, ranks: Ranks, pattern: str):
        import regex
        self.ranks, self.known = ranks, {}
        self.split, self.cut = regex.compile(pattern).findall, regex.compile(r"\S\s").search

    def stretches(self, text: str):
        a = 0
        while len(text) - a > STRETCH:
            found = self.cut(text, a + STRETCH)
            if not found:
                break
            yield text[a:found.start() + 1]
            a = found.start() + 1
        yield text[a:]

    def encode(self, texts) -> list:
        """Packed ids (little-endian unsigned 32-bit) of each text."""
        out, held, size = [], [], 0
        for text in texts:
            if len(text) > STRETCH:
                self._flush(held, out)
                held, size, parts = [], 0, []
                for part in self.stretches(text):
                    self._flush([self.split(part)], parts)
                out.append(b"".join(parts))
                continue
            held.append(self.split(text))
            size += len(text)
            if size > STRETCH:
                self._flush(held, out)
                held, size = [], 0
        self._flush(held, out)
        return out

    def _flush(self, held: list, out: list) -> None:
        pieces = set().union(*held)
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = pieces
        found = merge_pieces(sorted(new), self.ranks)
        self.known.update(found)
        out.extend(b"".join(map(self.known.__getitem__, p)) for p in held)
        for text in found:  # long pieces are rare and large, they are not remembered
            if len(text) > WIDE:
                del self.known[text]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_CODERS: dict = {}


def _coder(sent, name: str, pattern: str) -> Coder:
    """The coder of this process; the last one made is kept for later tasks."""
    if (name, pattern) not in _CODERS:
        _CODERS.clear()
        _CODERS[name, pattern] = Coder(sent.value, pattern)
    return _CODERS[name, pattern]


def byte_bpe(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, with_decoded: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` but the text, with n_tokens, ids_sha256 and
    decoded_sha256; on request also ``ids`` (array of int) and ``decoded`` (binary).
    ``path`` names a rank file; ``pattern`` must never match a space behind a
    non-space, as the patterns of byte-level tokenizers."""
    need(docs, "text")
    d = without(docs, *OUT)
    keep = [c for c in d.columns if c.lower() != "text"]
    d = d.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("decoded", T.BinaryType())] * with_decoded
    schema = T.StructType([d.schema[c] for c in keep] + fields)
    ranks = read_ranks(path)
    name = hashlib.sha256(repr(sorted(ranks.ids.items())).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        coder = _coder(sent, name, pattern)
        for batch in batches:
            texts = batch.column(len(keep))
            n_tokens, ids_sha, decoded_sha, ids, decoded = [], [], [], [], []
            for packed in coder.encode(cell.as_py() for cell in texts):
                n_tokens.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                raw = coder.decode(packed)
                decoded_sha.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(packed, "<i4"))
                if with_decoded:
                    decoded.append(raw)
            cols = [pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            cols += [pa.array(ids, pa.list_(pa.int32()))] * with_ids + [pa.array(decoded, pa.binary())] * with_decoded
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + cols, schema.names)

    return d.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """All rows and columns with ``decoded``, the bytes of the tokens in ``ids``; null
    ids decode to nothing, an id outside the vocabulary raises."""
    need(rows, "ids")
    d = without(rows, "decoded")
    at = [c.lower() for c in d.columns].index("ids")
    schema = T.StructType([*d.schema.fields, T.StructField("decoded", T.BinaryType())])
    sent = rows.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        tokens = sent.value.tokens
        for batch in batches:
            cells = [b"".join(tokens[i] for i in cell.as_py() or ()) for cell in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], schema.names)

    return d.mapInArrow(run, schema)


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
