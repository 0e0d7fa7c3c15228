"""Periodic runs: stretches of words that repeat with a period at least four times over.

Block matching with integer sequences as Aho-Corasick keys. At scale B, a power of two, the aligned blocks of B words are
the keys of one automaton and the words are searched for them. A run of period q and four periods or more holds a whole
aligned block and its next copy q words on, for the largest B with 2B - 1 <= 3q; so an occurrence counts as a seed of
scale B where its distance q has that scale. A seed is extended to both sides, word by word, as long as words q apart are
equal, and is a run if it is long enough. Scales ascend, so a smaller period is known before its multiples are met, and
blocks that lie inside a known run with all their seeds are no keys.

Words of a run recur: every four in a row of them stand twice in it or more. A text is cut where that fails, again and again
until it fails nowhere; what is left is searched stretch by stretch. Memory follows the longest text.

Each text is searched whole, and no row meets another. Null counts as empty, which has no words. Repeated rows are searched
one by one; a null id is returned as it came. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, table

TIMES, LEAST, GRAM = 4, 6, 4  # periods and words that a run has at least; words in a row that must recur in it


def recurring(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches in which every GRAM words in a row recur; every run lies within one of them."""
    if len(ids) < LEAST:
        return []
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    gram = h[: len(ids) - GRAM + 1].copy()
    for k in range(1, GRAM):
        gram = mix(gram * np.uint64(3) + h[k : len(ids) - GRAM + 1 + k])
    at = np.arange(len(gram))  # places of grams that are still left
    part = np.zeros(len(gram), np.int64)  # and the stretch of each
    while len(at):
        key = mix(gram[at] + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        many = np.zeros(len(at), bool)
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
        now = at[many]
        if not len(now):
            return []
        edge = np.concatenate(([True], (np.diff(now) > 1) | (np.diff(part[many]) != 0)))
        number = np.cumsum(edge) - 1
        size = np.bincount(number)
        long = size[number] >= LEAST - GRAM + 1
        if long.all() and len(now) == len(at):
            first = np.flatnonzero(edge)
            return [(int(now[a]), int(now[a]) + int(n) + GRAM - 1) for a, n in zip(first, size, strict=True)]
        at, part = now[long], number[long]
    return []


def reach(ids: np.ndarray, at: int, q: int, step: int) -> int:
    """How many places from `at` on, in steps of 1 or -1, words equal those q places further on."""
    n, size = 0, 64
    while True:
        if step > 0:
            a, b = at + n, min(at + n + size, len(ids) - q)
            differ = np.flatnonzero(ids[a:b] != ids[a + q : b + q]) if b > a else np.zeros(0, np.int64)
        else:
            a, b = max(0, at - n - size + 1), at - n + 1
            differ = np.flatnonzero((ids[a:b] != ids[a + q : b + q])[::-1]) if b > a else np.zeros(0, np.int64)
        if len(differ):
            return n + int(differ[0])
        n += max(0, b - a)
        if b - a < size:
            return n
        size = min(size * 4, 1 << 16)


def scale_periods(block: int) -> tuple[int, int]:
    """Smallest and largest period whose scale is this block length; 1 and 2 share the smallest."""
    return max(1, -(-(2 * block - 1) // (TIMES - 1))), -(-(4 * block - 1) // (TIMES - 1)) - 1


class Stretches:
    """Disjoint stretches [start, end); whether one holds a place."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, at: int) -> bool:
        k = bisect_right(self.starts, at) - 1
        return k >= 0 and self.ends[k] > at

    def add(self, start: int, end: int) -> None:
        k = bisect_right(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def searched(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a stretch."""
    runs: dict[tuple[int, int], int] = {}  # period by (start, length)
    words = tuple(ids.tolist())
    n, block = len(words), 2
    while scale_periods(block)[0] * TIMES <= n:
        low, high = scale_periods(block)
        high = min(high, n // TIMES)
        starts = sorted(a for a, _ in runs)
        reached = list(accumulate((a + m for a, m in sorted(runs)), max))
        # two periods of which the block has both: the smaller one divides the other, so a run that holds a seed has its period
        inside = lambda a, b: (k := bisect_right(starts, a)) > 0 and reached[k - 1] >= b  # noqa: B023, E731
        blocks: dict[tuple[int, ...], list[int]] = {}
        for s in range(0, n - block - low + 1, block):
            if not inside(s, min(n, s + high + block)):
                blocks.setdefault(words[s : s + block], []).append(s)
        found: set[tuple[int, int, int]] = set()
        if blocks:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            for k, key in enumerate(blocks):
                automaton.add_word(key, k)
            automaton.make_automaton()
            met: list[list[int]] = [[] for _ in blocks]
            for end, k in automaton.iter(words):
                met[k].append(end - block + 1)
            done: dict[int, Stretches] = defaultdict(Stretches)  # by period
            for own, there in zip(blocks.values(), met, strict=True):
                for s in own:
                    for o in there[bisect_left(there, s + low) : bisect_right(there, s + high)]:
                        q = o - s
                        if done[q].holds(s) or inside(s, o + block):
                            continue
                        a, b = s - reach(ids, s - 1, q, -1), s + reach(ids, s, q, 1)
                        done[q].add(a, b)
                        if b - a + q >= max(LEAST, TIMES * q):
                            found.add((q, a, b - a + q))
        for q, a, length in sorted(found):
            runs.setdefault((a, length), q)  # a multiple of the period of a run has the same ends
        block *= 2
    return [(a, length, q) for (a, length), q in runs.items()]


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period."""
    return sorted(((s + a, n, q) for a, b in recurring(ids) for s, n, q in searched(ids[a:b])), key=lambda r: (r[0], r[2]))


def repeated_tail(words: list[bytes], h: int) -> list[bytes]:
    """The contract's documents with h % 10 = 0: from a word on, the next few words over and over."""
    n = len(words)
    if not n or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * -(-(n - a) // p))[: n - a]


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def without(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that stay when each run keeps its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


SHAPE = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, repeat_tails: bool = False, slice_bytes: int = 4 << 20) -> DataFrame:
    """Of each document the number of its runs, its longest one, and digests of the list of runs and of the text without
    repetitions; with `texts` also the list itself, `runs`, and that text, `collapsed`."""

    def one(i: int | None, text: str | None) -> dict:
        words = (text or "").encode().split()
        if repeat_tails and i is not None:
            words = repeated_tail(words, zlib.crc32(str(i).encode()))
        runs = runs_of(numbered(words))
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        left = b" ".join(without(words, runs))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        row = {"doc_id": i, "n_runs": len(runs), "start": start, "length": length, "period": period, "exponent_milli": None if not runs else 1000 * length // period}
        row |= {"runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(left).hexdigest()}
        return row | ({"runs": [{"start": s, "length": n, "period": q} for s, n, q in runs], "collapsed": left.decode()} if texts else {})

    more = [pa.field("runs", pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))), pa.field("collapsed", pa.string())]
    schema = pa.schema([pa.field(x.split()[0], pa.string() if "string" in x else pa.int64()) for x in SHAPE.split(", ")] + more * texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                yield pa.RecordBatch.from_pylist([one(i, t) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)], schema)

    shape = SHAPE + ", runs array<struct<start: long, length: long, period: long>>, collapsed string" * texts
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, shape)


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs(table(spark, sf_dir, "documents"), repeat_tails=True)
