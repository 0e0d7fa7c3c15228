"""The binary Golay code (23, 12, 7): nearest codewords and the keys of the fuzzy hash.

The code is perfect: every 23-bit word lies within 3 bits of exactly one codeword. A word within 2 bits of its
codeword has that codeword's index as its only key; a word 3 bits away also takes the five codewords 4 bits away.
Two words that differ in at most 2 bits then share a key.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

N, K = 23, 12
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the code's generator polynomial


def _remainder(word: int) -> int:
    for shift in range(N - 1, 10, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - 11)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of each bit, error patterns by syndrome, how many there are).

    patterns[s, i] are the differences to the codewords that serve as keys of a word with syndrome s."""
    bit = np.array([_remainder(1 << i) for i in range(N)], np.int64)
    near: dict[int, list[int]] = {0: [0]}
    four: dict[int, list[int]] = {}
    for weight in (1, 2, 3, 4):
        for at in combinations(range(N), weight):
            s = int(np.bitwise_xor.reduce(bit[list(at)]))
            pattern = sum(1 << i for i in at)
            (near if weight < 4 else four).setdefault(s, []).append(pattern)
    patterns, count = np.zeros((2048, 6), np.int64), np.ones(2048, np.int64)
    for s in range(2048):
        keys = near[s] + (four.get(s, []) if near[s][0].bit_count() == 3 else [])
        patterns[s, : len(keys)], count[s] = keys, len(keys)
    return bit, patterns, count


def syndrome(words: np.ndarray) -> np.ndarray:
    bit = tables()[0]
    out = np.zeros(len(words), np.int64)
    for i in range(N):
        out ^= np.where(words >> i & 1, bit[i], 0)
    return out


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 6 codeword indices, how many of the six count) of 23-bit words."""
    _, patterns, count = tables()
    s = syndrome(words)
    return (words[:, None] ^ patterns[s]) >> 11, count[s]  # a systematic code: the top 12 bits name the codeword
