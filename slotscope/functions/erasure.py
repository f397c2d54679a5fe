"""Reed-Solomon coding over GF(256), vectorised over the bytes of a shard."""

from __future__ import annotations

import numpy as np

#: Fixed value: the field's polynomial.
POLYNOMIAL = 0x11D


def _tables() -> tuple[np.ndarray, np.ndarray]:
    power, log = np.zeros(512, np.uint8), np.zeros(256, np.int64)
    x = 1
    for i in range(255):
        power[i] = power[i + 255] = x
        log[x] = i
        x <<= 1
        x ^= POLYNOMIAL if x & 0x100 else 0
    return power, log


POWER, LOG = _tables()


def times(a: np.ndarray, b: int) -> np.ndarray:
    return np.where((a == 0) | (b == 0), 0, POWER[LOG[a] + LOG[b]]).astype(np.uint8)


def inverse(a: int) -> int:
    return int(POWER[255 - LOG[a]])


def parity_rows(k: int, m: int) -> np.ndarray:
    """A Cauchy matrix: every square part of it can be inverted, so any k shards give the data."""
    return np.array([[inverse((k + i) ^ j) for j in range(k)] for i in range(m)], np.uint8)


def combine(rows: np.ndarray, shards: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), shards.shape[1]), np.uint8)
    for i, row in enumerate(rows):
        for c, shard in zip(row, shards, strict=True):
            out[i] ^= times(shard, int(c))
    return out


def encode(data: bytes, k: int, m: int) -> list[bytes]:
    """k data shards of ceil(len / k) bytes, filled up with zeros, and m parity shards."""
    size = max(1, -(-len(data) // k))
    shards = np.frombuffer(data.ljust(size * k, b"\0"), np.uint8).reshape(k, size)
    return [s.tobytes() for s in (*shards, *combine(parity_rows(k, m), shards))]


def _invert(matrix: np.ndarray) -> np.ndarray:
    n = len(matrix)
    work = np.concatenate([matrix.copy(), np.eye(n, dtype=np.uint8)], 1)
    for i in range(n):
        pivot = i + int(np.flatnonzero(work[i:, i])[0])
        work[[i, pivot]] = work[[pivot, i]]
        work[i] = times(work[i], inverse(int(work[i, i])))
        for j in range(n):
            if j != i and work[j, i]:
                work[j] ^= times(work[i], int(work[j, i]))
    return work[:, n:]


def decode(shards: list[bytes | None], k: int, m: int, length: int) -> bytes:
    """The data from any k shards; the others are None."""
    there = [i for i, s in enumerate(shards) if s is not None]
    if len(there) < k:
        raise ValueError(f"{len(there)} of {k} shards are left")
    whole = np.concatenate([np.eye(k, dtype=np.uint8), parity_rows(k, m)])[there[:k]]
    got = np.array([np.frombuffer(shards[i], np.uint8) for i in there[:k]])
    return combine(_invert(whole), got).tobytes()[:length]
