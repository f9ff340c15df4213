"""Suffix order of a text by two-stage sorting, in numpy, for one bounded buffer.

Suffixes smaller than their successor are sorted directly; every other suffix is
induced from its successor by scanning the buckets of first bytes upwards; then
neighbours are compared. Order is exact to ``depth`` bytes, which is all that
strings of that length need."""

from __future__ import annotations

import numpy as np


def words_at(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number."""
    view = np.ndarray(shape=(len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
    return view[at].astype(np.uint64)


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later; the
    text counts as ended by a byte below all others."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    step = np.zeros(n, np.int8)
    step[:-1] = np.where(text[1:] > text[:-1], 1, np.where(text[1:] < text[:-1], -1, 0))
    step[-1] = -1
    # within a run of one byte the first change after the run decides
    place = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    nearest = np.minimum.accumulate(place[::-1])[::-1]
    return step[nearest] == 1


def sort_directly(padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the ``depth`` bytes from each position. Each round
    compares eight more bytes, and only of positions that are equal so far."""
    first = words_at(padded, at)
    order = np.argsort(first)
    at = at[order]
    first = first[order]
    tied = np.zeros(len(at), bool)
    same = first[1:] == first[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    group = np.cumsum(np.concatenate(([True], ~same))) if len(at) else np.zeros(0, np.int64)
    for k in range(8, depth, 8):
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        w = words_at(padded, at[rows] + k)
        g = group[rows]
        order = np.lexsort((w, g))
        at[rows] = at[rows][order]
        w = w[order]
        same = (w[1:] == w[:-1]) & (g[1:] == g[:-1])  # g is sorted, and the order keeps its runs
        again = np.zeros(len(rows), bool)
        again[1:] |= same
        again[:-1] |= same
        tied[rows] = again
        # rows of one group are neighbours, so a running number tells the new groups apart
        group[rows] = np.cumsum(np.concatenate(([True], ~same)))
    return at


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The positions for which ``wanted`` holds, in the order of their suffixes."""
    n = len(text)
    if not n or not wanted.any():
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    direct = smaller_than_next(text)
    # a larger suffix is induced from its successor, so chains are kept up to the
    # next directly sorted suffix (or the end of the text)
    place = np.where(direct, np.arange(n, dtype=np.int32), np.int32(n))
    base = np.minimum.accumulate(place[::-1])[::-1]
    at = np.flatnonzero(wanted)
    ends = np.bincount(np.minimum(base[at], n - 1) + 1, minlength=n + 1)[:n].astype(np.int32)
    needed = np.cumsum(wanted - ends, dtype=np.int32) > 0
    seeds = sort_directly(padded, np.flatnonzero(needed & direct), depth)
    by_byte = np.searchsorted(text[seeds], np.arange(257))
    induced = needed & ~direct
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def hand_on(found: np.ndarray) -> None:
        """Put the predecessors that are induced at the ends of their buckets."""
        before = found[found > 0] - 1
        before = before[induced[before]]
        if not len(before):
            return
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.flatnonzero(np.diff(byte)) + 1
        for part in np.split(before, cuts):
            waiting[text[part[0]]].append(part)

    if needed[n - 1] and not direct[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        k = 0
        while k < len(waiting[c]):  # a bucket may feed itself: runs of one byte
            out.append(waiting[c][k])
            hand_on(waiting[c][k])
            k += 1
        part = seeds[by_byte[c]:by_byte[c + 1]]
        if len(part):
            out.append(part)
            hand_on(part)
        waiting[c] = []
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each neighbour pair of ``order`` the length of the common prefix, at most
    ``depth``, in steps of eight bytes below it (enough to tell ``depth`` apart)."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    out = np.zeros(max(len(order) - 1, 0), np.int32)
    alive = np.arange(len(out))
    for k in range(0, depth, 8):
        take = min(8, depth - k)
        a, b = words_at(padded, order[alive] + k), words_at(padded, order[alive + 1] + k)
        if take < 8:
            a, b = a >> np.uint64(64 - 8 * take), b >> np.uint64(64 - 8 * take)
        alive = alive[a == b]
        out[alive] = k + take
        if not len(alive):
            break
    return out
