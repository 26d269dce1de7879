"""Word splitting at byte level, for texts that arrive as UTF-8 columns of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken together up to so many bytes: bounds what a task holds of them as Python objects.
SLICE_BYTES = 500_000
#: The C library's own way to give freed memory back, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Lower-cases A-Z and turns every ASCII byte but a-z and 0-9 into a space; bytes from 0x80 stay.
ALNUM_TABLE = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


_KEPT: list = []


def kept_by_worker(make):
    """Decorator: what ``make`` returned (for the last two of its arguments) stays in the worker until a task begins that doesn't name it as its own."""
    made = lru_cache(maxsize=2)(make)
    _KEPT.append(made)
    return made


def slices(batches, text_col: int | str, most: int = SLICE_BYTES, own=None):
    """The batches in runs of rows whose texts have about ``most`` bytes; a row is never split.

    A worker lives on, so another operator's `kept_by_worker` (but ``own``) goes first, and behind the last row
    freed memory goes back to the system: else the worker would keep both beside what this and the next stage need.
    """
    if others := [made for made in _KEPT if made is not own and made.cache_info().currsize]:
        for made in others:
            made.cache_clear()
        released()
    yield from _runs(batches, text_col, most)
    released()


def released() -> None:
    """Gives memory that is freed, but held by allocators, back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _runs(batches, text_col: int | str, most: int):
    for b in batches:
        ends = np.cumsum(np.nan_to_num(pc.binary_length(b.column(text_col)).to_numpy(zero_copy_only=False).astype(np.float64)))
        first = 0
        while first < b.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
            yield b.slice(first, last - first)
            first = last


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def spaced_words(text: bytes) -> list[bytes]:
    """Words between spaces and control characters 9 to 13, A-Z lower-cased."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased."""
    return text.translate(ALNUM_TABLE).split()


def ragged(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``sizes[k]`` places from ``firsts[k]`` on, for each k in turn."""
    return np.repeat(firsts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Numbers(dict):
    """word -> a number that is given out in order of first sight."""

    def __init__(self, first: int = 0):
        super().__init__()
        self.first = first

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.first + len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


#: Bytes between words, and the same with A-Z lower-cased, for arrays of bytes.
_GAP = np.isin(np.arange(256), [*range(9, 14), 32])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class HashedWords:
    """The spaced words of several texts as 64-bit hashes, made for all words at once, eight bytes a step.

    ``firsts[k]`` to ``firsts[k + 1]`` are the words of text k; ``starts`` and ``ends`` are places
    in the joined texts, of which text k begins at ``begins[k]``.
    """

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n" + bytes(8), np.uint8)
        self.data = data[:-8]
        self.begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
        edges = np.flatnonzero(np.diff(_GAP[self.data])) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        self.firsts = np.searchsorted(self.starts, self.begins)
        low, sizes = _LOWER[data], self.ends - self.starts
        eight = np.ndarray((len(low) - 7,), np.uint64, low, strides=(1,))
        self.hashes, todo, at = sizes.astype(np.uint64), np.arange(len(sizes)), 0
        while len(todo):
            part = eight[self.starts[todo] + at] & _MASKS[np.minimum(sizes[todo] - at, 8)]
            self.hashes[todo] = mixed((self.hashes[todo] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ part)
            at += 8
            todo = todo[sizes[todo] > at]

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.firsts[k] : self.firsts[k + 1]]

    def characters(self) -> np.ndarray:
        """How many code points stand before each byte."""
        return np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
