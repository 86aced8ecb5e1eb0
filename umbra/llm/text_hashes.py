"""Hashed views of words, kept in arrays so that n-grams of whole texts are made at once."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import zlib

import numpy as np
import pyarrow as pa

#: Words a worker remembers before it starts anew, some 200 bytes each.
REMEMBERED = 150_000
_EDGES = re.compile(r"^\W+|\W+$")
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Hands what a task has freed back to the system, as its worker may stay idle beside other stages' tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:  # glibc only
        trim(0)


class Remembered(dict):
    """Values of words, made when a word is first met."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = self.compute(word)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def during(self, batches):
        """``batches``, after whose end everything is forgotten, as a worker may stay idle beside other stages' tasks."""
        try:
            yield from batches
        finally:
            self.clear()
            give_back()


def crc(text: str) -> int:
    return zlib.crc32(text.encode())


def stem_and_word(word: str) -> int:
    """The hashes of a word without outer punctuation (upper half) and of its first four letters (lower half)."""
    bare = _EDGES.sub("", word)
    return crc(bare) << 32 | crc("4" + bare[:4])


def shape_and_word(word: str) -> int:
    """The hash of a word (upper half) and of its shape (lower half): runs of capitals, letters and digits become A, a and 0."""
    shape = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", word)
    shape = re.sub(r"\d+", "0", shape)
    return crc(word) << 32 | crc(shape[:12])
