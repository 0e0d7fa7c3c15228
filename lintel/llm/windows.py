"""Runs of windows that share their minimizer, and their pieces: what lets equal windows meet in one place."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import prefix_hash, ragged, span_hash

LONG = 1 << 21  # bytes read at once; places within them need fewer than the 24 bits they have


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = 24, most: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in data, windows, minimizer, its place in data) of the runs of all windows of `length` bytes.

    A window's minimizer is the leftmost of its grams with the lowest hash. Equal windows have equal minimizers at the
    same place in them. A run is a stretch of a text's windows whose minimizer is the same gram at the same place, as long
    as can be but where a text of more than `most` bytes is cut: such texts are read in overlapping parts."""
    if len(data) <= most:
        return short_runs(data, offsets, length, gram)
    got = []
    for i in range(len(offsets) - 1):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        for at in range(lo, max(lo + 1, hi - length + 1), most):
            part = data[at : min(hi, at + most + length - 1)]
            _, begin, count, m, place = short_runs(part, np.array([0, len(part)]), length, gram)
            got.append((np.full(len(begin), i), begin + at, count, m, place + at))
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def short_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    if not n.sum():
        return none, none, none, none.astype(np.uint64), none
    at = np.arange(len(data) - gram + 1)
    value = span_hash(prefix_hash(data), at, at + gram)
    low = (value & np.uint64(~((1 << 24) - 1) & (1 << 64) - 1)) | at.astype(np.uint64)
    reach, span = 1, length - gram + 1
    while reach * 2 <= span:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)  # of the minimizer of the window that starts at each byte
    del low
    text = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    own = place[start]
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (text[1:] != text[:-1]))))
    count = np.diff(np.append(first, len(start)))
    return text[first], start[first], count, value[own[first]], own[first]


def pieces(data: memoryview, begin: np.ndarray, count: np.ndarray, place: np.ndarray, length: int, gram: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, windows, group) of runs cut by the offset of the minimizer in the window, in cells of 2^bits offsets.

    The windows of a cell have the bytes around the minimizer in common that each of them covers. A piece's group is a hash
    of those, so equal windows are in pieces of one group, with the minimizer at the same offset."""
    last = place - begin  # of the first window; the offset falls by one from window to window
    low = last - count + 1
    run, k = ragged((last >> bits) - (low >> bits) + 1)
    cell = (last >> bits)[run] - k
    top = np.minimum(last[run], (cell + 1 << bits) - 1)
    n = top - np.maximum(low[run], cell << bits) + 1
    a, b = place[run] - (cell << bits), place[run] - np.minimum((cell + 1 << bits) - 1, length - gram) + length
    digest = xxhash.xxh3_64_intdigest
    group = np.fromiter((digest(data[x:y], z) for x, y, z in zip(a.tolist(), b.tolist(), (cell << 8 | bits).tolist(), strict=True)), np.uint64, len(run))
    return run, place[run] - top, n, group
