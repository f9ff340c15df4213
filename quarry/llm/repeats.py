"""Byte strings of a fixed length that repeat across rows, found by suffix arrays.

A global suffix array can't be built in one task, so suffixes are dealt out first
in a way that brings equal strings together. Every string of ``window`` bytes has
an anchor: its leftmost ``gram`` of smallest hash. Equal strings have equal
anchors, and neighbouring strings mostly share theirs, so a text becomes runs:
stretches of strings with one anchor, each sent once (about 67 bytes for 18
strings) to the bucket of its anchor. In a bucket, runs whose anchor only one row
holds can't match anything, nor can runs that agree with no other row on either side
of the anchor; the others are laid end to end, their suffixes are
sorted in two stages, and neighbours with a common prefix of ``window`` bytes are
occurrences of one string.

Before the shuffle each block of rows keeps one run per content (a long text of
one byte, or thousands of copies, send little); what the block itself shows to be
covered is reported from there. So an anchor that a third of all rows share is met
at most once per block and content. Runs of one anchor in ever other surroundings
don't collapse; so anchors whose runs pass HOT_BYTES are looked for first in a sample
of stretches, and their runs are cut into single strings, dealt by the hash of the
whole string, which equal strings share. The sample only decides how strings are
dealt, never which are compared. Buckets are as many as the bytes need; large
ones are worked off in slices of whole anchors, or of whole strings. Nothing is kept
outside tasks, so a lost executor only repeats its own blocks and buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import tidied, tidy
from quarry.llm.suffix import common_prefixes, suffix_order

BUCKET_BYTES = 20 << 20   # of runs, uncompressed
BLOCK_BYTES = 8 << 20     # of text per block
CHUNK = 1 << 18           # positions hashed at a time
SLICE_BYTES = 1 << 20     # of runs per suffix array
HOT_BYTES = 16 << 20      # of runs of one anchor that go to one bucket
STRETCH = 4096            # bytes per stretch of the sample
SAMPLE = 64               # one stretch of so many is sampled
RUNS = "kind int, bucket int, id long, tag long, blob binary"
SPANS = "id long, tag long, span long"
MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, gram: int, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (1 to 16) bytes from each position of ``data``,
    which has 16 spare bytes at its end, or from the positions ``at``."""
    view = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    low = view[:len(data) - 16] if at is None else view[at]
    if gram <= 8:
        return mix64((low << np.uint64(64 - 8 * gram)) * MULT + np.uint64(gram))
    high = view[gram - 8:len(data) + gram - 24] if at is None else view[at + gram - 8]
    return mix64(low * MULT ^ mix64(high))


def anchors(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position of ``data`` (with ``window`` + 16 spare bytes) the place of
    its string's anchor, and the hashes of grams."""
    h = gram_hashes(data, gram)
    n, width = len(data) - window - 16, window - gram + 1
    low = (h >> np.uint64(32)).astype(np.uint32)
    place = np.arange(len(low), dtype=np.int32)
    have = 1
    while have < width:  # double the stretch whose leftmost smallest hash is known
        step = min(have, width - have)
        other = low[step:] < low[:-step]
        place = np.where(other, place[step:], place[:-step])
        low = np.where(other, low[step:], low[:-step])
        have += step
    return place[:n], h


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[first], reach[np.concatenate((first[1:], [True]))]


def pack(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Per row its merged intervals as pairs of int32."""
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], ends[order]
    cuts = np.flatnonzero(np.diff(rows)) + 1
    for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(rows)]))):
        if b > a:
            s, e = merge(starts[a:b], ends[a:b])
            yield int(rows[a]), np.column_stack((s, e)).astype(np.int32).tobytes()


def unpack(spans) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of spans (start in the upper half of a long)."""
    spans = np.asarray(spans, np.int64)
    return merge(spans >> 32, spans & 0xFFFFFFFF)


def merge_by_row(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged intervals of each row: rows, and spans."""
    shift = rows.astype(np.int64) << 33  # rows lie apart on one line
    s, e = merge(starts + shift, ends + shift)
    mask = (1 << 33) - 1
    return s >> 33, ((s & mask) << 32) | (e & mask)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given stretches, one after another."""
    first = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return first + np.arange(int(lengths.sum()))


# ---------------------------------------------------------------- blocks


def find_runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, salts: np.ndarray, window: int, gram: int):
    """Runs of a block: row, start, length in bytes, anchor hash, content hash and the
    anchor's place in the run.
    ``begins`` and ``ends``: the rows' texts in ``data``, in ascending order."""
    powers = np.multiply.accumulate(np.full(CHUNK + 128, MULT, np.uint64))
    inverse = np.uint64(pow(int(MULT), -1, 1 << 64))
    inverses = np.multiply.accumulate(np.full(CHUNK + 128, inverse, np.uint64))
    table = mix64(np.arange(1, 257, dtype=np.uint64) * MULT)
    found = []
    lo, hi = int(begins[0]), int(ends[-1])
    spare = window + 16
    for at in range(lo, hi, CHUNK):
        to = min(at + CHUNK, hi)
        part = np.zeros(to - at + spare, np.uint8)
        part[:min(len(data), to + spare) - at] = data[at:to + spare]
        r0, r1 = np.searchsorted(ends, at, side="right"), np.searchsorted(begins, to)
        if r0 >= r1:
            continue
        b, e = np.clip(begins[r0:r1], at, to), np.clip(ends[r0:r1] - window + 1, at, to)
        counts = np.maximum(e - b, 0)  # strings that start here and end inside their row
        if not counts.sum():
            continue
        q = ranges(b - at, counts).astype(np.int32)
        row = np.repeat(np.arange(r0, r1), counts)
        place, h = anchors(part, window, gram)
        anchor = place[q]
        first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (q[1:] != q[:-1] + 1))))
        length = np.diff(np.concatenate((first, [len(q)]))) + window - 1
        start = q[first].astype(np.int64)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(table[part] * powers[:len(part)], dtype=np.uint64)))
        content = (sums[start + length] - sums[start]) * inverses[start]
        gram_hash = mix64(h[anchor[first]] ^ salts[row[first]])
        found.append((row[first], start + at, length, gram_hash, content, (anchor[first] - start).astype(np.int16)))
    if not found:
        return None
    return [np.concatenate(x) for x in zip(*found)]


def single_strings(data, row, start, length, anchor, inner, window):
    """The strings of runs as runs of one string each, in the form of ``find_runs``."""
    powers = np.multiply.accumulate(np.full(int(length.max()), MULT, np.uint64))
    inverse = np.uint64(pow(int(MULT), -1, 1 << 64))
    inverses = np.multiply.accumulate(np.full(len(powers), inverse, np.uint64))
    table = mix64(np.arange(1, 257, dtype=np.uint64) * MULT)
    first = np.cumsum(length) - length
    inside = ranges(np.zeros(len(length), np.int64), length)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(table[data[ranges(start, length)]] * powers[inside], dtype=np.uint64)))
    count = length - window + 1
    of = np.repeat(np.arange(len(length)), count)
    step = ranges(np.zeros(len(length), np.int64), count)
    at = first[of] + step
    content = (sums[at + window] - sums[at]) * inverses[step]
    return row[of], start[of] + step, np.full(len(of), window, np.int64), anchor[of], content, (inner[of] - step).astype(np.int16)


def block_rows(data, begins, ends, ids, tags, salts, window, gram, n_buckets, smaller, hot=None):
    """Rows of RUNS for one block: its runs by bucket, and what it covers itself.
    ``hot``: sorted anchor hashes whose strings are dealt singly."""
    order = np.argsort(begins, kind="stable")
    begins, ends, ids, tags, salts = (x[order] for x in (begins, ends, ids, tags, salts))
    found = find_runs(data, begins, ends, salts, window, gram)
    if found is None:
        return
    single = np.zeros(len(found[0]), bool)
    if hot is not None and len(hot):
        single = hot[np.minimum(np.searchsorted(hot, found[3]), len(hot) - 1)] == found[3]
    if single.any():
        row, start, length, anchor, _, inner = (x[single] for x in found)
        found = [np.concatenate((x[~single], y)) for x, y in zip(found, single_strings(data, row, start, length, anchor, inner, window))]
        single = np.arange(len(found[0])) >= np.count_nonzero(~single)
    row, start, length, anchor, content, inner = found
    key = mix64(content + anchor * MULT)
    order = np.lexsort((ids[row], key))
    row, start, length, anchor, key, inner, single = (x[order] for x in (row, start, length, anchor, key, inner, single))
    first = np.concatenate(([True], key[1:] != key[:-1]))
    run = np.cumsum(first) - 1
    head = np.flatnonzero(first)
    least, own = ids[row[head]][run], ids[row]
    offset = start - begins[row]
    if smaller:
        covered, sent = own != least, own == least
        extra = np.zeros(0, np.int64)
    else:  # a content of two rows covers itself; other rows must learn of both
        tail = np.concatenate((head[1:], [len(run)])) - 1
        several = ids[row[head]] != ids[row[tail]]
        covered, sent = several[run], own == least
        extra = tail[several]
    if covered.any():
        for r, spans in pack(row[covered], offset[covered], (offset + length)[covered]):
            yield 1, int(mix64(np.array([ids[r]], np.int64).view(np.uint64))[0] % np.uint64(n_buckets)), int(ids[r]), int(tags[r]), spans
    # one record per content and row; the places of its occurrences go along
    rows = np.flatnonzero(sent)
    rec_first = rows[np.concatenate(([True], (run[rows][1:] != run[rows][:-1]) | (row[rows][1:] != row[rows][:-1])))]
    n_places = np.diff(np.concatenate((np.searchsorted(rows, rec_first), [len(rows)])))
    places = offset[rows]
    place_at = np.cumsum(n_places) - n_places
    bucket = (np.where(single, key, anchor) % np.uint64(n_buckets)).astype(np.int64) * 2 + single
    rec = np.concatenate((rec_first, extra))
    n_places = np.concatenate((n_places, np.zeros(len(extra), np.int64)))
    place_at = np.concatenate((place_at, np.zeros(len(extra), np.int64)))
    order = np.lexsort((offset[rec], ids[row[rec]], bucket[rec]))  # ascending numbers pack well
    rec, n_places, place_at = rec[order], n_places[order], place_at[order]
    cuts = np.flatnonzero(np.diff(bucket[rec])) + 1
    packer = zstandard.ZstdCompressor(level=5)
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(rec)]))):
        r = rec[a:b]
        used, local = np.unique(rank[row[r]], return_inverse=True)
        used = by_id[used]
        parts = [
            np.array([len(r), len(used), int(n_places[a:b].sum()), int(length[r].sum())], np.int64),
            np.diff(ids[used], prepend=0), tags[used], salts[used], np.diff(local, prepend=0).astype(np.int32), length[r].astype(np.int16), inner[r],
            n_places[a:b].astype(np.int32), places[ranges(place_at[a:b], n_places[a:b])].astype(np.int32),
            data[ranges(start[r], length[r])],
        ]
        yield 2 * int(single[r[0]]), int(bucket[r[0]]) // 2, 0, 0, packer.compress(b"".join(x.tobytes() for x in parts))


def _buffers(column: pa.Array):
    """Bytes and row limits of a binary column without a copy."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    limits = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), limits


def scan(batches, window, gram, n_buckets, smaller, hot=None):
    for batch in batches:
        data, limits = _buffers(batch.column("data"))
        ids = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False)
        tags = batch.column("tag").to_numpy(zero_copy_only=False)
        salts = batch.column("grp").to_numpy(zero_copy_only=False).view(np.uint64)
        fits = (limits[1:] - limits[:-1] >= window) & ~np.asarray(batch.column("id").is_null())
        keep = np.flatnonzero(fits)
        if not len(keep):
            continue
        block = (np.cumsum((limits[1:] - limits[:-1])[keep]) - 1) // BLOCK_BYTES
        for part in np.split(keep, np.flatnonzero(np.diff(block)) + 1):
            out = list(block_rows(data, limits[part], limits[part + 1], ids[part], tags[part], salts[part],
                                  window, gram, n_buckets, smaller, hot))
            for k in range(0, len(out), 256):
                cols = list(zip(*out[k:k + 256]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())], ["kind", "bucket", "id", "tag", "blob"])


def anchor_bytes(batches, window, gram):
    """(anchor, bytes): of the runs of each batch of stretches, each content once."""
    for batch in batches:
        data, limits = _buffers(batch.column("data"))
        salts = batch.column("grp").to_numpy(zero_copy_only=False).view(np.uint64)
        found = find_runs(data, limits[:-1], limits[1:], salts, window, gram) if len(batch) else None
        if found is None:
            continue
        _, _, length, anchor, content, _ = found
        _, first = np.unique(mix64(content + anchor * MULT), return_index=True)
        names, of = np.unique(anchor[first], return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(of, length[first]).astype(np.int64))],
                                         ["anchor", "bytes"])


def hot_anchors(d: DataFrame, window: int, gram: int) -> tuple[np.ndarray, int]:
    """Sorted hashes of the anchors whose runs in ``d`` (id, data, grp) probably pass
    HOT_BYTES, and about how many bytes all their runs have."""
    size = F.octet_length("data")
    stretches = F.filter(F.sequence(F.lit(0), F.floor((size - 1) / STRETCH).cast("int")),
                         lambda k: F.pmod(F.xxhash64("id", k, F.lit(5)), F.lit(SAMPLE)) == 0)
    sample = d.select("grp", F.explode(F.transform(
        stretches, lambda k: F.substring(F.col("data"), k * STRETCH + 1, F.lit(STRETCH + window - 1)))).alias("data"))
    got = (sample.mapInArrow(lambda it: anchor_bytes(it, window, gram), "anchor long, bytes long")
           .groupBy("anchor").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") >= HOT_BYTES // SAMPLE // 2).collect())
    return np.sort(np.array([r["anchor"] for r in got], np.int64).view(np.uint64)), SAMPLE * sum(r["bytes"] for r in got)


# ---------------------------------------------------------------- buckets


def read_blob(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, n_rows, n_places, n_bytes = (int(x) for x in np.frombuffer(raw, np.int64, 4))
    at, out = 32, []
    for kind, count in ((np.int64, n_rows), (np.int64, n_rows), (np.uint64, n_rows), (np.int32, n), (np.int16, n),
                        (np.int16, n), (np.int32, n), (np.int32, n_places), (np.uint8, n_bytes)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    out[0], out[3] = np.cumsum(out[0]), np.cumsum(out[3], dtype=np.int64)  # sent as differences
    return out


def covered_strings(text, begins, lengths, ids, salts, window, smaller):
    """For each byte of ``text`` whether a string of ``window`` bytes starts there
    that its record's row has to give up."""
    starts = np.zeros(len(text), bool)
    starts[ranges(begins, lengths - window + 1)] = True
    order = suffix_order(text, starts, window)
    if not len(order):
        return starts
    owner = np.searchsorted(begins, order, side="right") - 1
    own, salt = ids[owner], salts[owner]
    new = common_prefixes(text, order, window) < window
    group = np.cumsum(np.concatenate(([True], new)))
    if (salt != salt[0]).any():  # equal strings of different groups are no matches
        by = np.lexsort((salt, group))
        order, own, salt, group = order[by], own[by], salt[by], group[by]
        new = (group[1:] != group[:-1]) | (salt[1:] != salt[:-1])
    head = np.flatnonzero(np.concatenate(([True], new)))
    size = np.diff(np.concatenate((head, [len(order)])))
    least = np.repeat(np.minimum.reduceat(own, head), size)
    hit = own > least if smaller else np.repeat(np.maximum.reduceat(own, head), size) != least
    out = np.zeros(len(text), bool)
    out[order[hit]] = True
    return out


def string_hashes(strings: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    h = np.zeros(len(strings), np.uint64)
    for k in range(strings.shape[1]):
        h = mix64((h + strings[:, k]) * MULT)
    return h


def shared_sides(text, begin, length, inner, anchor, ids, window: int, gram: int) -> np.ndarray:
    """Which runs can hold a string of another row. A string that holds its anchor has
    at least half of its other bytes on one side of it, so that many bytes before or
    after the anchor, with the anchor, must be in a run of another id."""
    half = -(-(window - gram) // 2)
    size = half + gram
    keep = np.zeros(len(begin), bool)
    for first in (inner - half, inner):
        at = np.flatnonzero((first >= begin) & (first + size <= begin + length))
        if not len(at):
            continue
        key = anchor[at]
        for k in sorted({*range(0, size - 16, 16), max(size - 16, 0)}):
            key = mix64(key * MULT + gram_hashes(text, min(size, 16), first[at] + k))
        order = np.argsort(key, kind="stable")
        key, own = key[order], ids[at][order]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        several = np.minimum.reduceat(own, head) != np.maximum.reduceat(own, head)
        keep[at[order[np.repeat(several, np.diff(np.append(head, len(key))))]]] = True
    return keep


def match_blobs(blobs, window: int, gram: int, smaller: bool, single: bool):
    """Spans (id, tag, span) of a bucket's runs; ``single``: each run is one string."""
    shift = np.cumsum([0] + [len(b[0]) for b in blobs])
    row_id, row_tag = np.concatenate([b[0] for b in blobs]), np.concatenate([b[1] for b in blobs])
    salt = np.concatenate([b[2] for b in blobs])
    row = np.concatenate([b[3] + s for b, s in zip(blobs, shift)])
    length = np.concatenate([b[4] for b in blobs]).astype(np.int64)
    begin = np.cumsum(length) - length
    inner = begin + np.concatenate([b[5] for b in blobs])
    n_places = np.concatenate([b[6] for b in blobs]).astype(np.int64)
    places = np.concatenate([b[7] for b in blobs])
    text = np.concatenate([b[8] for b in blobs] + [np.zeros(16, np.uint8)])
    del blobs
    place_at = np.cumsum(n_places) - n_places
    anchor = mix64(gram_hashes(text, gram, inner) ^ salt[row])  # as the blocks had it
    name = anchor if not single else mix64(anchor * MULT + string_hashes(text[:-16].reshape(-1, window)))
    # only anchors, or single strings, that two rows hold can match
    order = np.argsort(name, kind="stable")
    ids = row_id[row[order]]
    head = np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1])))
    size = np.diff(np.concatenate((head, [len(order)])))
    shared = np.repeat(np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head), size)
    order, name_of = order[shared], np.repeat(np.arange(len(head)), size)[shared]
    if not single and len(order):
        keep = shared_sides(text, begin[order], length[order], inner[order], anchor[order], row_id[row[order]], window, gram)
        order, name_of = order[keep], name_of[keep]
    got = []
    if len(order):
        upto = np.cumsum(length[order])
        part = upto // SLICE_BYTES
        # whole names stay together: a slice ends with the one that fills it
        last = np.concatenate((name_of[1:] != name_of[:-1], [True]))
        part = part[np.flatnonzero(last)[np.searchsorted(np.flatnonzero(last), np.arange(len(order)))]]
        for rec in np.split(order, np.flatnonzero(np.diff(part)) + 1):
            lens = length[rec]
            starts = np.cumsum(lens) - lens
            hit = covered_strings(text[ranges(begin[rec], lens)], starts, lens, row_id[row[rec]], anchor[rec], window, smaller)
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            owner = np.searchsorted(starts, at, side="right") - 1
            first = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])))
            end = at[np.concatenate((first[1:], [True]))] + window
            at, owner = at[first], owner[first]
            s, e, who = at - starts[owner], end - starts[owner], rec[owner]
            times = n_places[who]
            where = places[ranges(place_at[who], times)].astype(np.int64)
            got.append((np.repeat(row[who], times), where + np.repeat(s, times), where + np.repeat(e, times)))
    if not got:
        return []
    r, spans = merge_by_row(*[np.concatenate(x) for x in zip(*got)])
    return [(row_id[r], row_tag[r], spans)]


def match_bucket(table: pa.Table, window: int, gram: int, smaller: bool) -> pa.Table:
    """Spans of one bucket's rows; spans that blocks reported pass through."""
    kinds = table.column("kind").to_numpy()
    passed = table.filter(pa.array(kinds == 1))
    pairs = [np.frombuffer(b, np.int32).reshape(-1, 2).astype(np.int64) for b in passed.column("blob").to_pylist()]
    times = [len(x) for x in pairs]
    out = [(np.repeat(passed.column("id").to_numpy(), times), np.repeat(passed.column("tag").to_numpy(), times),
            (x[:, 0] << 32) | x[:, 1])] if (x := np.concatenate(pairs) if pairs else None) is not None else []
    for kind in (0, 2):
        blobs = [read_blob(b) for b in table.filter(pa.array(kinds == kind)).column("blob").to_pylist()]
        if blobs:
            out += match_blobs(blobs, window, gram, smaller, kind == 2)
    cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(("id", "tag", "span"), (pa.array(c, pa.int64()) for c in cols))))


def repeated_spans(rows: DataFrame, id_col: Column, data: Column, group: Column | None = None, window: int = 50,
                   gram: int = 12, smaller: bool = True, bucket_bytes: int = BUCKET_BYTES,
                   total_bytes: int | None = None, tagged: bool | None = None) -> DataFrame:
    """(id, tag, span): stretches of bytes covered by repeated strings, start and end in
    one long; those of a row are merged with ``unpack``. ``tag`` is 0, or the hash of
    the bytes if there are ids whose rows differ (see ``same_row``).

    ``smaller``: a string counts if a row of a smaller id holds it; else if any row
    of another id does. ``group``: strings match only inside a group. Rows without
    an id take no part. ``total_bytes``: an estimate of the bytes of all rows, for the
    number of buckets; counted where it isn't given. ``tagged``: whether to hash the
    bytes; looked up where it isn't given, which reads all rows once more."""
    if not 1 <= gram <= min(16, window):
        raise ValueError("gram must be 1 to 16 and not longer than the window")
    d = rows.select(id_col.cast("long").alias("id"), data.cast("binary").alias("data"),
                    (F.xxhash64(group) if group is not None else F.lit(0).cast("long")).alias("grp"))
    d = d.filter(F.col("id").isNotNull() & (F.octet_length("data") >= window))
    # hashes don't pack; they are only needed where rows of different bytes share an id
    if tagged is None:
        h = F.xxhash64("data")
        tagged = not d.groupBy("id").agg(F.min(h).alias("a"), F.max(h).alias("b")).filter("a <> b").isEmpty()
    d = d.withColumn("tag", F.xxhash64("data") if tagged else F.lit(0).cast("long"))
    total = total_bytes if total_bytes is not None else d.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    spread = 1 + (window - 1) * 2 / (window - gram + 2)  # bytes of runs per byte of text
    n_buckets = max(1, math.ceil(total * spread / bucket_bytes))
    hot = np.zeros(0, np.uint64)
    if total * spread > HOT_BYTES:  # else no anchor can have so many
        hot, more = hot_anchors(d, window, gram)
        longest = 2 * window - gram  # bytes of a run, which has window - gram + 1 strings
        n_buckets = max(1, math.ceil((total * spread + more * (window - gram + 1) * window / longest) / bucket_bytes))
    runs = d.mapInArrow(lambda it: tidy(scan(it, window, gram, n_buckets, smaller, hot)), RUNS)
    return runs.groupBy("bucket").applyInArrow(lambda t: tidied(match_bucket(t, window, gram, smaller)), SPANS)


def same_row(id_col: Column, data: Column) -> Column:
    """Join condition between a table and the spans of its rows."""
    return (id_col.cast("long") == F.col("id")) & ((F.col("tag") == 0) | (F.col("tag") == F.xxhash64(data)))
