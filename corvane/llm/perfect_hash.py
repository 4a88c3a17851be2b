"""Minimal perfect hashing of integer keys, built in pieces by Spark tasks.

Keys are dealt to buckets by a hash.  In each bucket a cascade of bit arrays is made:
keys that are alone at their place of a level's array set its bit, the others go on
to the next level.  All buckets' arrays stand one after another, and a key's number
is that of the set bits before its own, so the numbers of n keys are 0 to n - 1.
The keys in that order are kept beside the bits and tell keys from strangers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import text as tx

#: Bits of a level for each key that is left.
GAMMA = 2
_LEVEL = 0x9E3779B97F4A7C15


def spread(keys: np.ndarray) -> np.ndarray:
    """24 bits that deal keys to buckets, up to 2**24 of them."""
    return (tx.mix(keys.astype(np.uint64)) >> tx.U64(40)).astype(np.int64)


def _places(keys: np.ndarray, level: int) -> np.ndarray:
    return tx.mix(keys.astype(np.uint64) * tx.U64(0xD6E8FEB86659FD93) + tx.U64((level + 1) * _LEVEL % (1 << 64))) >> tx.U64(1)


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels in bits, the bits as 64-bit words, and the distinct keys in the order of their numbers."""
    sizes, words, ordered, level = [], [], [], 0
    while len(keys):
        size = max(64, -(-GAMMA * len(keys) // 64) * 64)
        place = (_places(keys, level) % tx.U64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        mine = alone[place]
        ordered.append(keys[mine][np.argsort(place[mine])])
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        keys, level = keys[~mine], level + 1
    return sizes, np.concatenate(words) if words else np.zeros(0, dtype=np.uint64), np.concatenate(ordered) if ordered else np.zeros(0, dtype=np.int64)


@dataclass
class PerfectHash:
    """``at[b, l]`` and ``size[b, l]``: the first bit and the bits of level l of bucket b."""

    at: np.ndarray
    size: np.ndarray
    words: np.ndarray
    before: np.ndarray
    keys: np.ndarray

    @staticmethod
    def of(buckets: int, parts: list[tuple[int, list[int], bytes, bytes]]) -> PerfectHash:
        """From (bucket, sizes, bits, keys) of every bucket that has keys."""
        parts = sorted(parts)
        levels = max((len(p[1]) for p in parts), default=0)
        at, size, start = np.zeros((buckets, levels), dtype=np.int64), np.zeros((buckets, levels), dtype=np.int64), 0
        for bucket, sizes, _, _ in parts:
            for level, n in enumerate(sizes):
                at[bucket, level], size[bucket, level], start = start, n, start + n
        words = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint64)
        ones = np.bitwise_count(words).astype(np.int64)
        return PerfectHash(at, size, words, np.cumsum(ones) - ones, np.frombuffer(b"".join(p[3] for p in parts), dtype=np.int64))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for keys that it was not built from."""
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        bucket = spread(keys) % max(1, len(self.at))
        for level in range(self.at.shape[1]):
            if not len(left):
                break
            own = bucket[left]
            left, own = left[self.size[own, level] > 0], own[self.size[own, level] > 0]
            bit = self.at[own, level] + (_places(keys[left], level) % self.size[own, level].astype(np.uint64)).astype(np.int64)
            word, below = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            here = (word >> below & tx.U64(1)) == 1
            number = self.before[bit >> 6] + np.bitwise_count(word & ((tx.U64(1) << below) - tx.U64(1))).astype(np.int64)
            out[left[here]] = number[here]
            left = left[~here]
        out[out >= 0] = np.where(self.keys[out[out >= 0]] == keys[out >= 0], out[out >= 0], -1)
        return out
