"""The perfect binary Golay code (23, 12, 7) as a fuzzy hash of 23-bit words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
BITS, DATA_BITS, CHECK_BITS = 23, 12, 11


@lru_cache(1)
def codewords() -> np.ndarray:
    """Codeword of each 12-bit index: multiples of the generator polynomial over GF(2)."""
    out = np.zeros(1 << DATA_BITS, np.int64)
    for bit in range(DATA_BITS):
        half = 1 << bit
        out[half : 2 * half] = out[:half] ^ (GENERATOR << bit)
    return out


def syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64).copy()
    for bit in range(BITS - 1, CHECK_BITS - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - CHECK_BITS))
    return rest


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes, up to six error patterns of weight 4 or less that have it (padded with -1); and the index of
    each codeword's top 12 bits, which are different for all codewords."""
    one = 1 << np.arange(BITS, dtype=np.int64)
    patterns = [np.zeros(1, np.int64)]
    last = [np.full(1, -1)]
    for _ in range(4):
        base, at = patterns[-1], last[-1]
        grown = [(base[at < b] | one[b], np.full(int((at < b).sum()), b)) for b in range(BITS)]
        patterns.append(np.concatenate([g[0] for g in grown]))
        last.append(np.concatenate([g[1] for g in grown]))
    everything = np.concatenate(patterns)
    s = syndrome(everything)
    order = np.argsort(s, kind="stable")
    counts = np.bincount(s, minlength=1 << CHECK_BITS)
    table = np.full((1 << CHECK_BITS, counts.max()), -1, np.int64)
    column = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    table[s[order], column] = everything[order]
    index = np.zeros(1 << DATA_BITS, np.int64)
    index[codewords() >> CHECK_BITS] = np.arange(1 << DATA_BITS)
    return table, index


def keys(words: np.ndarray) -> np.ndarray:
    """words x 6: indices of the codewords within distance 4, padded with -1; one or six a word.

    Any two words that differ in 2 bits or fewer share an index. A word within 2 bits of a codeword has that one alone; a word 3
    bits off has it and the 5 at distance 4."""
    table, index = _tables()
    errors = table[syndrome(words)]
    found = index[(words.astype(np.int64)[:, None] ^ np.maximum(errors, 0)) >> CHECK_BITS]
    return np.where(errors < 0, -1, found)
