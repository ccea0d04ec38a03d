"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from tidemark.sources.checkpoints import durable, shared_folder

__all__ = ["WORD", "WordHash", "binary", "durable", "hand_back", "mix", "shared_folder", "window_hashes", "word_hashes"]

#: Java pattern of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
MASK64 = (1 << 64) - 1
PRIME = np.uint64(0x9E3779B97F4A7C15)


def binary(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, one after the other, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return (value.as_py() for value in column.cast(kind))


def hand_back() -> None:
    """Return free memory to the system at a task's end: Python workers live on and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


class WordHash(dict):
    """64-bit hash of a word (bytes); the commonest words are remembered."""

    limit = 120_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value


def word_hashes(words: list[bytes], table: WordHash) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``k`` consecutive words; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = h[:n] + np.uint64(seed & MASK64)
    for j in range(1, k):
        acc = acc * PRIME
        acc += h[j : j + n]
    return mix(acc)
