"""A minimal acyclic transducer from byte words to numbers, compiled to flat arrays that workers memory-map.

States with equal futures are shared (sorted insertion, registering each suffix once), and every arc carries the count
of accepted words that come before it, so the sum along a word's path is the word's place in sorted order. Lookup
walks all words of a batch at once, one byte a round.
"""

from __future__ import annotations

import numpy as np
from pyarrow.fs import LocalFileSystem

from .common import filesystem


def compile_words(entries: dict[bytes, list[int]]) -> bytes:
    """entries: word -> ids. The image: a header of lengths, then arc keys, targets, outputs, final flags, id offsets, ids."""
    ordered = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open nodes along the last word: [final, arcs]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))

    for w in ordered:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        close(same)
        path.extend([False, []] for _ in range(len(w) - same))
        path[-1][0] = True
        last = w
    close(0)
    root = freeze(path[0])
    below = [0] * len(states)  # accepted words from a state on; targets are frozen before their sources
    keys, targets, outputs = [], [], []
    for s, (final, arcs) in enumerate(states):
        n = int(final)
        for byte, to in arcs:
            keys.append(s << 8 | byte)
            targets.append(to)
            outputs.append(n)
            n += below[to]
        below[s] = n
    finals = np.array([f for f, _ in states], np.int64)
    ids = [entries[w] for w in ordered]
    arrays = [np.array(keys, np.int64), np.array(targets, np.int64), np.array(outputs, np.int64), finals, np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64), np.array([i for x in ids for i in x], np.int64)]
    head = np.array([root, *(len(a) for a in arrays)], np.int64)
    return b"".join(a.tobytes() for a in (head, *arrays))


class Transducer:
    """A compiled lexicon over its image."""

    def __init__(self, whole: np.ndarray) -> None:
        self.root, at, parts = int(whole[0]), 7, []
        for n in whole[1:7]:
            parts.append(whole[at : at + int(n)])
            at += int(n)
        self.keys, self.targets, self.outputs, self.finals, self.id_offsets, self.ids = parts

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each word data[start:end], or -1."""
        state, total = np.full(len(starts), self.root), np.zeros(len(starts), np.int64)
        out = np.full(len(starts), -1)
        live = np.flatnonzero(ends > starts)
        if not len(self.keys):
            return out
        step = 0
        while len(live):
            key = state[live] << 8 | data[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, at = live[hit], at[hit]
            state[live] = self.targets[at]
            total[live] += self.outputs[at]
            step += 1
            done = starts[live] + step == ends[live]
            stop = live[done]
            good = stop[self.finals[state[stop]] == 1]
            out[good] = total[good]
            live = live[~done]
        return out


_open: dict[str, Transducer] = {}


def mapped(path: str) -> Transducer:
    """The image at a path of the shared folder, memory-mapped where the folder is mounted, else read."""
    if path not in _open:
        fs, own = filesystem(path)
        if isinstance(fs, LocalFileSystem):
            whole = np.memmap(own, np.int64, "r")
        else:
            with fs.open_input_file(own) as f:
                whole = np.frombuffer(f.read(), np.int64)
        _open.clear()
        _open[path] = Transducer(whole)
    return _open[path]
