"""Word and shingle hashes for the operators that compare texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Words whose hashes a Python worker remembers.
REMEMBERED = 250_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


_HASHES = _Hashes()
#: Odd multipliers for the places in a shingle, from a fixed seed.
_PLACES = np.random.default_rng(20).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def words_in(text: str, lower: bool = False) -> list[bytes]:
    """Maximal runs of characters other than space and U+0009 to U+000D, which are what bytes split at; lower-cased
    from A to Z only."""
    content = text.encode("utf-8", "surrogatepass")
    return (content.lower() if lower else content).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words."""
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, size: int, first: int = 0) -> np.ndarray:
    """64-bit hashes of each run of ``size`` words; none if there are fewer. Another ``first`` of the multipliers gives
    other hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * _PLACES[first]
    for k in range(1, size):
        total += hashes[k : k + n] * _PLACES[first + k]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    return total


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """The distinct shingles, sorted; a shorter text is one shingle, an empty one has none."""
    if 0 < len(hashes) < size:
        return windows(hashes, len(hashes)) + np.uint64(len(hashes))
    return np.unique(windows(hashes, size))


def sequence_key(hashes: np.ndarray) -> bytes:
    """A 128-bit digest of a word sequence."""
    return blake2b(hashes.tobytes(), digest_size=16).digest()


def in_slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of a bounded amount of text (or of one row)."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most_bytes / max(most_bytes, batch.column(column).nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


class Bits:
    """A bit for each residue of a mixed 64-bit key: a set of bounded size that may hold more than was put in. ``log2``
    bits are collected as 64-bit words."""

    def __init__(self, log2: int, words: np.ndarray, values: np.ndarray) -> None:
        self.log2, self.at, self.values = log2, words.astype(np.int32), values.astype(np.int64).view(np.uint64)
        self.words: np.ndarray | None = None

    def __getstate__(self) -> tuple:
        """Only words with a bit travel."""
        return self.log2, self.at, self.values

    def __setstate__(self, state: tuple) -> None:
        self.log2, self.at, self.values = state
        self.words = None

    def has(self, keys: np.ndarray) -> np.ndarray:
        if self.words is None:
            self.words = np.zeros(1 << (self.log2 - 6), np.uint64)
            self.words[self.at] = self.values
        at = keys.astype(np.uint64, copy=False) & np.uint64((1 << self.log2) - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
