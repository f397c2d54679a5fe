"""Words of whole text columns as 64-bit hashes, made for all rows of an Arrow batch at once."""

from __future__ import annotations

import numpy as np

from slotscope.llm.shared import chunks, utf8_column

#: The white space that parts words: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x decides about half of the bits that come out."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE_VALUE = stream(256, 11)
BASE = np.uint64(0x5851F42D4C957F2D)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of the rows; no word crosses a row's end."""
    solid = ~SPACE[data]
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[begins] = solid[begins]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = begins[1:] - 1
    last[ends] = solid[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal bytes wherever they stand."""
    with np.errstate(over="ignore"):
        power, inverse = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * power[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts])


def words_of(column, most_bytes: int = 1 << 20):
    """Yields (first row, row count, word hashes, words of each row's end offsets) of the lower-cased texts, chunk by chunk."""
    data, offsets = utf8_column(column)
    for i, j in chunks(offsets, most_bytes):
        part, at = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends = split_words(part, at)
        yield i, j - i, hash_words(part, starts, ends), np.searchsorted(starts, at)


#: For segments: letters, digits and bytes beyond ASCII belong together, other marks too; white space and control bytes part them.
KIND = np.full(256, 2, np.uint8)
KIND[:0x21] = 0
KIND[0x7F] = 0
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def split_segments(data: np.ndarray, offsets: np.ndarray, marks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of word bytes, and with marks of every run of other marks; none crosses a row's end."""
    kind = KIND[data] if marks else (KIND[data] == 1).astype(np.uint8)
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(len(kind) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] > 0
    return starts[keep], ends[keep]


def hash_segments(column, marks: bool = False, prefix: int = 0, most_bytes: int = 1 << 20):
    """As words_of, for the lower-cased texts' segments; with prefix, a second column of hashes for so many bytes of each."""
    data, offsets = utf8_column(column)
    for i, j in chunks(offsets, most_bytes):
        part, at = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends = split_segments(part, at, marks)
        hashes = hash_words(part, starts, ends)
        if prefix:
            hashes = np.stack([hashes, mix(hash_words(part, starts, np.minimum(starts + prefix, ends)) ^ np.uint64(prefix))], 1)
        yield i, j - i, hashes, np.searchsorted(starts, at)
