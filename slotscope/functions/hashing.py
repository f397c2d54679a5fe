"""Hashes that Spark lacks, vectorised over Arrow batches: XXH64 with seed 0 of 16-byte ids, and splitmix64."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_of_16(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of each id's 16 bytes, high and low in big-endian order."""
    with np.errstate(over="ignore"):
        h = np.full(len(high), P5 + np.uint64(16))
        for word in (high.byteswap(), low.byteswap()):
            h = _rotate(h ^ (_rotate(word * P2, 31) * P1), 27) * P1 + P4
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def splitmix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def value_bytes(key: int, length: int) -> np.ndarray:
    """The bytes that a key's value has: the low byte of splitmix64(key ^ splitmix64(place))."""
    return (splitmix64(np.uint64(key) ^ splitmix64(np.arange(length, dtype=np.uint64))) & np.uint64(0xFF)).astype(np.uint8)


@F.pandas_udf(T.LongType())
def xxh64_bucket(high: pd.Series, low: pd.Series) -> pd.Series:
    """The 16-bit bucket of an id."""
    found = xxh64_of_16(high.to_numpy(np.int64).view(np.uint64), low.to_numpy(np.int64).view(np.uint64))
    return pd.Series((found & np.uint64(0xFFFF)).astype(np.int64))


@F.pandas_udf(T.LongType())
def splitmix(x: pd.Series) -> pd.Series:
    return pd.Series(splitmix64(x.to_numpy(np.int64).view(np.uint64)).view(np.int64))


def values_of(keys: np.ndarray, length: int) -> np.ndarray:
    """A row of bytes for each key."""
    return (splitmix64(keys[:, None] ^ splitmix64(np.arange(length, dtype=np.uint64))[None, :]) & np.uint64(0xFF)).astype(np.uint8)


#: Bytes of values that are made at once.
MADE_BYTES = 1 << 20


def _equal_lengths(lengths: np.ndarray):
    """Rows of one length, as many as are made at once; lengths below 0 are left out."""
    order = np.argsort(lengths, kind="stable")
    order = order[np.searchsorted(lengths[order], 0) :]
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else ():
        step = max(1, MADE_BYTES // max(1, int(lengths[part[0]])))
        yield from (part[i : i + step] for i in range(0, len(part), step))


@F.pandas_udf(T.BinaryType())
def key_value(key: pd.Series, length: pd.Series) -> pd.Series:
    keys, n, out = key.to_numpy(np.int64).view(np.uint64), length.to_numpy(np.int64), np.empty(len(key), object)
    for rows in _equal_lengths(n):
        for i, value in zip(rows, values_of(keys[rows], int(n[rows[0]])), strict=True):
            out[i] = value.tobytes()
    return pd.Series(out)


@F.pandas_udf(T.BooleanType())
def value_is_right(key: pd.Series, value: pd.Series) -> pd.Series:
    """Whether every byte of a value is the one its key gives; null isn't right."""
    keys, right = key.to_numpy(np.int64).view(np.uint64), np.zeros(len(key), bool)
    n = np.array([-1 if v is None else len(v) for v in value], np.int64)
    for rows in _equal_lengths(n):
        given = np.frombuffer(b"".join(value.iloc[i] for i in rows), np.uint8).reshape(len(rows), -1) if n[rows[0]] else np.zeros((len(rows), 0), np.uint8)
        right[rows] = (given == values_of(keys[rows], int(n[rows[0]]))).all(1)
    return pd.Series(right)


#: Fixed value: the reflected polynomial of CRC-32C.
CASTAGNOLI = 0x82F63B78


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1).astype(np.uint32)
    return table


CRC_TABLE = _crc_table()


def crc32c_of(values: list[bytes | None]) -> np.ndarray:
    """CRC-32C of each value, the j-th bytes of all of them at once; null counts as empty."""
    lengths = np.array([len(v or b"") for v in values], np.int64)
    order = np.argsort(-lengths, kind="stable")
    data = np.frombuffer(b"".join(values[i] or b"" for i in order), np.uint8)
    starts, sorted_lengths = np.cumsum(lengths[order]) - lengths[order], lengths[order]
    crc = np.full(len(values), 0xFFFFFFFF, np.uint32)
    for j in range(int(sorted_lengths[0]) if len(values) else 0):
        n = int(np.searchsorted(-sorted_lengths, -j))  # values longer than j
        crc[:n] = CRC_TABLE[(crc[:n] ^ data[starts[:n] + j]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(values), np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


@F.pandas_udf(T.LongType())
def crc32c(value: pd.Series) -> pd.Series:
    return pd.Series(crc32c_of([None if v is None else bytes(v) for v in value]))


def mixed_size(number: Column, mix: tuple[tuple[int, int], ...]) -> Column:
    """The size of a number's share of a mix of (size, percent), by number % 100; the percents make 100."""
    if sum(p for _, p in mix) != 100:
        raise ValueError("the mix's percents must make 100")
    found, upto = F.lit(mix[-1][0]), 100 - mix[-1][1]
    for size, percent in reversed(mix[:-1]):
        found = F.when(number % 100 < upto, F.lit(size)).otherwise(found)
        upto -= percent
    return found


def bench_key(number: Column) -> Column:
    return F.concat(F.lit("k"), F.lpad(number.cast("string"), 20, "0"))


def rendered(value: Column) -> tuple[Column, Column]:
    """Bytes as people read them: in hex, and as text in which what isn't UTF-8 is replaced."""
    return F.lower(F.hex(value)), F.make_valid_utf8(value.cast("string"))
