"""Words of whole texts, found and hashed by numpy over Arrow batches.

A word is a maximal run of bytes other than space and 0x09-0x0D; UTF-8 keeps
those bytes for themselves, so cutting bytes equals cutting characters.  Only
A-Z are lower-cased.  Batches are worked through in pieces of about a quarter of a megabyte
(or one text, if longer), which bounds the memory of a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, up to n at least."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * PIECE_BYTES)
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values (empty, if too few)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = _power_tables(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix64((sums[width:] - sums[:n]) * inverse[:n], width)


@dataclass
class Piece:
    """Consecutive texts: their bytes and the words in them."""

    first: int  #: index of the first text in its batch
    data: np.ndarray  #: bytes of all texts
    offsets: np.ndarray  #: where each text starts, and the end
    starts: np.ndarray  #: first byte of each word
    ends: np.ndarray  #: end of each word
    counts: np.ndarray  #: words before each text, and of all texts

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def owners(self) -> np.ndarray:
        """Index within the piece of each word's text."""
        return np.repeat(np.arange(len(self)), np.diff(self.counts))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        power, inverse = _power_tables(len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=sums[1:])
        return mix64((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def words(self, k: int) -> list[bytes]:
        """The words of text ``k``, if white space parts them."""
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes().split()


def texts_and_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    if not len(array):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return at - at[0], raw


#: Bytes between words when only letters and digits count; all of a multi-byte character counts as letters.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def pieces(array: pa.Array, lower: bool, between: np.ndarray = _SPACE) -> Iterator[Piece]:
    """Cuts a batch of texts into pieces and finds their words; ``between`` says which bytes part words."""
    at, raw = texts_and_bytes(array)
    k, n = 0, len(at) - 1
    while k < n:
        j = max(k + 1, int(np.searchsorted(at, at[k] + PIECE_BYTES, "right")) - 1)
        data = raw[at[k] : at[j]]
        data = _LOWER[data] if lower else data
        offsets = at[k : j + 1] - at[k]
        inside = ~between[data]
        before = np.empty(len(data), bool)  # no word reaches here from the left
        before[1:] = ~inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(inside & before)
        after = np.empty(len(data), bool)
        after[:-1] = ~inside[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = True
        ends = np.flatnonzero(inside & after) + 1
        yield Piece(k, data, offsets, starts, ends, np.searchsorted(starts, offsets))
        k = j


def owners_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts) - 1), np.diff(counts))
