"""A minimal perfect hash function over distinct 64-bit keys, built level by level.

Each level has a bit array; a key that is alone at its bit stays there, the others go to the next level. A key's slot is
the rank of its bit over all levels: 0..n-1 without gaps, a constant expected number of probes per lookup.
"""

from __future__ import annotations

import numpy as np

from .bytesops import U64, mix

#: Bits of a level for each key that reaches it.
GAMMA = 2
_RANK_WORDS = 8


def _at(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(keys ^ U64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % U64(bits)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(bits of each level, all levels as one array of 64-bit words)."""
    sizes, words, level = [], [], 0
    while len(keys):
        bits = 64 * max(1, -(-GAMMA * len(keys) // 64))
        at = _at(keys, level, bits)
        alone = np.bincount(at, minlength=bits) == 1
        sizes.append(bits)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        keys = keys[~alone[at]]
        level += 1
        if level > 200:
            raise ValueError("keys are not distinct")
    return sizes, np.concatenate(words) if words else np.zeros(0, "<u8")


def ranks(words: np.ndarray) -> np.ndarray:
    """Set bits before each word."""
    ones = np.bitwise_count(words).astype(np.int64)
    return np.concatenate([[0], np.cumsum(ones)])


def slots(keys: np.ndarray, sizes: list[int], words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Slot of each key; -1 where no level has its bit. Unknown keys may get a slot: compare fingerprints."""
    out = np.full(len(keys), -1, np.int64)
    left, first = np.arange(len(keys)), 0
    for level, bits in enumerate(sizes):
        if not len(left):
            break
        at = _at(keys[left], level, bits)
        word, bit = first + at // 64, (at % 64).astype(U64)
        hit = (words[word] >> bit) & U64(1) == 1
        inside = words[word] & ((U64(1) << bit) - U64(1))
        out[left[hit]] = (before[word] + np.bitwise_count(inside))[hit]
        left, first = left[~hit], first + bits // 64
    return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + U64(0xA24BAED4963EE407)) >> U64(32)).astype("<u4")
