"""Sets of word shingles and their circulant MinHash signatures."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Words whose hashes a worker remembers before it starts anew.
MEMO = 1 << 18
#: Values that are permuted at once.
AT_ONCE = 1 << 15


class Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO:
            self[word] = found
        return found


_words = Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles of ``width`` words.

    A-Z are lower-cased; words are runs of anything but ASCII blanks. A text
    with fewer words is one shingle; one without words has none.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) >= MEMO:
        _words.clear()
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):  # the order of words counts
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(words) - width + 1 + k])
    return np.unique(out)


def set_hash(shingles: np.ndarray) -> bytes:
    """128 bits of a whole set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class Circulant:
    """Circulant MinHash (Li and Li, 2021): a first permutation breaks up the set, a second one, shifted by k, gives coordinate k.

    The universe is the 32-bit numbers on a circle, the permutations are two
    seeded bijections of it, so that a shift is an addition that wraps around.
    """

    def __init__(self, size: int, seed: int = 1):
        self.size, self.seed = size, np.uint64(seed)

    @staticmethod
    def _permuted(x: np.ndarray) -> None:
        """The second permutation, in place (the finaliser of MurmurHash3)."""
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(self.size, 0xFFFFFFFF, np.uint32)
        first = (_mixed(shingles ^ self.seed) >> np.uint64(32)).astype(np.uint32)
        shifts = (np.arange(self.size, dtype=np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        step = max(1, AT_ONCE // max(1, len(first)))
        for part in range(0, len(first), AT_ONCE):
            some = first[part : part + AT_ONCE]
            for k in range(0, self.size, step):
                shifted = some[None, :] - shifts[k : k + step, None]
                self._permuted(shifted)
                np.minimum(out[k : k + step], shifted.min(axis=1), out=out[k : k + step])
        return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` coordinates; equal keys of different bands differ."""
    parts = signature.astype(np.uint64).reshape(-1, rows)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for k in range(rows):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return key.view(np.int64)
