"""Words of Arrow text columns as 64-bit hashes, without a Python object per word.

A word is a maximal run of bytes other than ASCII white space. Words are hashed eight bytes at a time, all words of a
slice at once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text is handled in slices of about so many bytes; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20

_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DROPPED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)]) & ~_SPACE
_OUTSIDE_ASCII = np.isin(np.arange(256), (0xC2, 0xE2, 0xE3, 0xEF, 0xF0))


class Words(NamedTuple):
    """hash[off[i]:off[i+1]] are row i's words; begin and end are their places in data, which for stripped words is the
    text without marks; row i is data[row[i]:row[i+1]]."""

    hash: np.ndarray
    off: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: np.ndarray
    row: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its row offsets; a null is an empty text."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = pc.fill_null(text, "")
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    row = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)[row[0] : row[-1]] if text.buffers()[2] else np.zeros(0, np.uint8)
    return data, row - row[0]


def plain(text: pa.Array) -> pa.Array:
    """Lower case, with marks and spaces outside ASCII turned into blanks."""
    text = pc.utf8_lower(pc.fill_null(text, ""))
    data, _ = flat(text)
    if _OUTSIDE_ASCII[data].any():
        text = pc.replace_substring_regex(text, r"[^\x00-\x7F\p{L}\p{N}\p{M}]+", " ")
    return text


def words(text: pa.Array, strip: bool = True) -> Words:
    """All words of a text column.

    strip: compare words in lower case by their letters and digits alone; words that have none are left out.
    Otherwise words are compared byte for byte.
    """
    data, row = flat(plain(text) if strip else text)
    if strip and len(data):
        at = np.flatnonzero(~_DROPPED[data])
        if len(at) < len(data):
            data, row = data[at], np.searchsorted(at, row)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(row), np.int64), none, none, data, row)
    ink = ~_SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    inner = row[(row > 0) & (row < n)]
    first[inner] = ink[inner]
    last[inner - 1] = ink[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(_hashed(data, begin, end), np.searchsorted(begin, row), begin, end, data, row)


def _hashed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = end - begin
    out = mix((eight[begin] & _LOW[np.minimum(left, 8)]) * _ODD[0] + left.astype(np.uint64))
    rest, out_at = np.flatnonzero(left > 8), None
    while len(rest):
        begin, left = begin[rest] + 8, left[rest] - 8
        out_at = rest if out_at is None else out_at[rest]
        out[out_at] = mix(out[out_at] * _ODD[1] + (eight[begin] & _LOW[np.minimum(left, 8)]) * _ODD[2])
        rest = np.flatnonzero(left > 8)
    return out


def beginnings(w: Words, n: int) -> np.ndarray:
    """Hashes of each word's first n bytes, at most 8, less those of a letter that goes on beyond them."""
    padded = np.concatenate((w.data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(w.data) + 1, "<u8", padded, strides=(1,))
    size = np.minimum(w.end - w.begin, n)
    for _ in range(3):
        size -= (size > 0) & ((padded[w.begin + size] & 0xC0) == 0x80)
    return mix((eight[w.begin] & _LOW[size]) * _ODD[1] + np.uint64(n))


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except AttributeError:  # another C library than glibc
        return lambda _: 0


def release() -> None:
    """Give freed memory back: workers live on from stage to stage, and what one of them keeps the next can't use."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(text: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes of text each."""
    _, row = flat(text)
    at, n = 0, len(row) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(row, row[at] + size, "right")) - 1))
        yield at, to
        at = to
    release()


def hash_words(phrase: str) -> np.ndarray:
    return words(pa.array([phrase], pa.string())).hash


def ngrams(hashes: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each row and their row offsets; a row of 1 to n-1 words has one, of all its words."""
    length = np.diff(off)
    count = np.where(length >= n, length - n + 1, (length > 0).astype(np.int64))
    to = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
    start = np.repeat(off[:-1] - to[:-1], count) + np.arange(to[-1])
    padded = np.concatenate((hashes, np.zeros(n, np.uint64)))
    stop = np.repeat(off[1:], count) if (length < n).any() else None
    out = np.zeros(len(start), np.uint64)
    for k in range(n):
        h = padded[start + k]
        if stop is not None:
            h = np.where(start + k < stop, h, np.uint64(0))
        out = mix(out * np.uint64(0xD1342543DE82EF95) + h + np.uint64(k + 1))
    return out, to


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values over each row's range, 0 for empty rows."""
    out = np.zeros((len(off) - 1, *values.shape[1:]), np.float64)
    some = np.flatnonzero(np.diff(off) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, off[some], axis=0)
    return out
