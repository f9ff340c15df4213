"""Words and hashes of many texts at once, in numpy over the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quarry.llm.repeats import MULT, _buffers, mix64, ranges

SLICE = 2 << 20  # bytes worked on at a time
_R = np.uint64(0xD6E8FEB86659FD93)


def ascii_lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_word_bytes() -> np.ndarray:
    """Bytes of words when the six ASCII spaces separate them."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def slices(column: pa.Array, size: int = SLICE):
    """(first row, bytes, begins, ends) of stretches of about ``size`` bytes; a longer
    row is a stretch of its own."""
    data, limits = _buffers(column)
    a = 0
    while a < len(limits) - 1:
        b = max(a + 1, int(np.searchsorted(limits, limits[a] + size, side="right")) - 1)
        part = data[limits[a]:limits[b]]
        yield a, part, limits[a:b] - limits[a], limits[a + 1:b + 1] - limits[a]
        a = b


def portions(batches, column: str, size: int = 4 * SLICE):
    """Batches cut into runs of rows of about ``size`` bytes of a column; a longer row is
    a batch of its own."""
    for batch in batches:
        _, limits = _buffers(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(limits, limits[a] + size, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def word_spans(part: np.ndarray, begins: np.ndarray, ends: np.ndarray, inside: np.ndarray):
    """Row, start and end of each word, a run of bytes for which ``inside`` holds."""
    w = np.zeros(len(part) + 1, bool)
    w[:-1] = inside[part]
    if not w.any():
        z = np.zeros(0, np.int64)
        return z, z, z
    begin = np.zeros(len(part) + 1, bool)
    begin[begins] = True
    prev = np.concatenate(([False], w[:-1]))
    start = np.flatnonzero(w & (~prev | begin))
    end = np.flatnonzero(prev & (~w | begin))
    return np.searchsorted(ends, start, side="right"), start, end


def span_hashes(part: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes (stretches may not contain each other);
    ``fold`` maps bytes before."""
    if len(start) > 1 and (start[1:] < start[:-1]).any():
        order = np.argsort(start, kind="stable")
        out = np.empty(len(start), np.uint64)
        out[order] = span_hashes(part, start[order], end[order], fold, seed)
        return out
    table = mix64((np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 10)) * MULT)
    if fold is not None:
        table = table[fold]
    out = np.empty(len(start), np.uint64)
    step = 1 << 20
    inverse = np.uint64(pow(int(_R), -1, 1 << 64))
    a = 0
    while a < len(start):  # stretches of about a million bytes, cut between words
        lo = start[a]
        b = max(a + 1, int(np.searchsorted(end, lo + step, side="right")))
        n = int(end[b - 1] - lo)
        powers = _powers(n, _R)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[part[lo:lo + n]] * powers, out=sums[1:])
        s, e = start[a:b] - lo, end[a:b] - lo
        out[a:b] = (sums[e] - sums[s]) * _powers(n + 1, inverse)[s]
        a = b
    return mix64(out ^ ((end - start).astype(np.uint64) * MULT))


_CACHE: dict = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    have = _CACHE.get(int(base))
    if have is None or len(have) < n:
        have = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(max(n, (1 << 20) + 1), base, np.uint64))))
        if n <= (1 << 20) + 2:
            _CACHE[int(base)] = have
    return have[:n]


__all__ = ["MULT", "ascii_lower_table", "mix64", "portions", "ranges", "slices", "space_word_bytes", "span_hashes", "word_spans"]
