"""A minimal perfect hash of integer keys in levels of bits, with a stored fingerprint for each key.

On each level the keys left are hashed into twice as many bits; a key alone on its bit stays there,
the others go to the next level. A key's slot is the number of bits set before its own, so n keys
have the slots 0 to n - 1 and a lookup reads one bit on each of a few levels.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from martwright.llm.common import mix

_SPREAD = 2
_STEP = 0x9E3779B97F4A7C15
_HEAD = struct.Struct("<8sQQQ")
_MAGIC = b"keyslots"
_MOST_LEVELS = 64


def _hashes(keys: np.ndarray, copies: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys.astype(np.int64).view(np.uint64) ^ mix(
            copies.astype(np.int64).view(np.uint64) + np.uint64(seed * _STEP & (1 << 64) - 1)
        ))


def _positions(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(hashes + np.uint64((level + 1) * _STEP & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


def _marks(hashes: np.ndarray) -> np.ndarray:
    return (mix(~hashes) >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class KeySlots:
    """Slots of pairs (key, copy) of whole numbers."""

    seed: int
    sizes: np.ndarray  # bits of each level
    words: np.ndarray  # the bits of all levels
    ranks: np.ndarray  # bits set before each word
    marks: np.ndarray  # fingerprint of the key in each slot

    @classmethod
    def build(cls, keys: np.ndarray, copies: np.ndarray) -> tuple[KeySlots, np.ndarray]:
        """The hash of distinct pairs, and the slot of each."""
        for seed in range(16):
            hashes = _hashes(keys, copies, seed)
            sizes, words, left, level = [], [], hashes, 0
            while len(left) and level < _MOST_LEVELS:
                size = -(-_SPREAD * len(left) // 64) * 64
                at = _positions(left, level, size)
                alone = np.bincount(at, minlength=size) == 1
                words.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
                sizes.append(size)
                left = left[~alone[at]]
                level += 1
            if not len(left):
                break
        else:
            raise ValueError("keys are not distinct")
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        counts = np.bitwise_count(flat).astype(np.int64)
        found = cls(seed, np.array(sizes, np.int64), flat, np.cumsum(counts) - counts,
                    np.zeros(len(keys), np.uint32))
        slots = found._slots(hashes)
        found.marks[slots] = _marks(hashes)
        return found, slots

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        slots = np.full(len(hashes), -1, np.int64)
        rows, first = np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes):
            at = first + _positions(hashes[rows], level, int(size))
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            slots[rows[hit]] = self.ranks[at[hit] >> 6] + np.bitwise_count(below)
            rows, first = rows[~hit], first + int(size)
        return slots

    def find(self, keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """The slot of each pair; -1 if its fingerprint is not the stored one."""
        hashes = _hashes(keys, copies, self.seed)
        slots = self._slots(hashes)
        if not len(self.marks):
            return slots
        return np.where((slots >= 0) & (self.marks[slots] == _marks(hashes)), slots, -1)

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(_MAGIC, self.seed, len(self.sizes), len(self.marks))
        return b"".join([
            head, self.sizes.astype("<i8").tobytes(), self.words.astype("<u8").tobytes(),
            self.marks.astype("<u4").tobytes(),
        ])

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[KeySlots, int]:
        """The hash, and the number of bytes it takes."""
        magic, seed, levels, n = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not an index file")
        at = _HEAD.size
        sizes = np.frombuffer(data, "<i8", levels, at).astype(np.int64)
        at += 8 * levels
        words = np.frombuffer(data, "<u8", int(sizes.sum()) // 64, at).astype(np.uint64)
        at += 8 * len(words)
        marks = np.frombuffer(data, "<u4", n, at).astype(np.uint32)
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(seed, sizes, words, np.cumsum(counts) - counts, marks), at + 4 * n
