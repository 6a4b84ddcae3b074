"""A sealed partition: minimal perfect hash plus fingerprints, all in flat numpy arrays.

Keys are 64-bit hashes.  Each level owns a bit array of ``GAMMA`` bits per remaining key; a key that
falls alone on a bit stays at that level, the others move on.  The slot of a key is the rank of its bit
over all levels, so the fingerprint array holds exactly one entry per key and no key is stored.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
#: Odd multipliers of a 64-bit mixing step (fixed values).
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A fresh 64-bit hash of 64-bit keys for each level."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64((level + 1) * MIX[0] & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
        return x ^ (x >> np.uint64(31))


class Sealed:
    """An immutable set of distinct 64-bit keys, probed with their fingerprints."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray):
        self.n, self.levels, start = len(keys), [], 0
        out = np.zeros(len(keys), prints.dtype)
        level = 0
        while len(keys):
            m = max(64, int(GAMMA * len(keys)) | 1)
            at = (mixed(keys, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            words = np.packbits(alone)
            # rank of the first bit of each byte, kept in steps of 8 bytes
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((m, words, counts[::8].astype(np.uint32), start))
            mine = alone[at]
            out[start + self._rank(words, counts[::8], at[mine])] = prints[mine]
            start += int(counts[-1])
            keys, prints, level = keys[~mine], prints[~mine], level + 1
        self.prints = out

    @staticmethod
    def _rank(words: np.ndarray, steps: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before position ``at``."""
        byte = at >> 3
        rank = steps[byte >> 3].astype(np.int64)
        base = byte & ~7
        for k in range(7):
            there = base + k
            rank += np.where(there < byte, np.bitwise_count(words[np.minimum(there, len(words) - 1)]), 0)
        return rank + np.bitwise_count(words[byte] >> (8 - (at & 7)).astype(np.uint16)).astype(np.int64)

    def has(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Whether each key's slot holds its fingerprint; never wrong for a sealed key."""
        hit = np.zeros(len(keys), bool)
        left = np.arange(len(keys))
        for level, (m, words, steps, start) in enumerate(self.levels):
            if not len(left):
                break
            at = (mixed(keys[left], level) % np.uint64(m)).astype(np.int64)
            on = (words[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            here = left[on]
            hit[here] = self.prints[start + self._rank(words, steps, at[on])] == prints[here]
            left = left[~on]
        return hit

    def dump(self) -> bytes:
        """The arrays one after another, each with its length."""
        parts = [np.array([self.n, len(self.levels)], np.int64), self.prints]
        for m, words, steps, start in self.levels:
            parts += [np.array([m, start], np.int64), words, steps]
        return b"".join(np.int64(a.nbytes).tobytes() + a.tobytes() for a in parts)

    @classmethod
    def load(cls, data: bytes) -> Sealed:
        at, parts = 0, []
        while at < len(data):
            size = int(np.frombuffer(data, np.int64, 1, at)[0])
            parts.append(data[at + 8 : at + 8 + size])
            at += 8 + size
        s = cls.__new__(cls)
        s.n = int(np.frombuffer(parts[0], np.int64)[0])
        s.prints = np.frombuffer(parts[1], np.uint32)
        s.levels = []
        for k in range(2, len(parts), 3):
            m, start = np.frombuffer(parts[k], np.int64).tolist()
            s.levels.append((m, np.frombuffer(parts[k + 1], np.uint8), np.frombuffer(parts[k + 2], np.uint32), start))
        return s

    def nbytes(self) -> int:
        return self.prints.nbytes + sum(w.nbytes + s.nbytes for _, w, s, _ in self.levels)
