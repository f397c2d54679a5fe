"""Golomb-Rice codes of sorted 64-bit fingerprints."""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray) -> bytes:
    """Sorted uint64 values as a count, a parameter, the gaps' quotients in unary and their remainders in k bits each."""
    n = len(values)
    if not n:
        return np.uint32(0).tobytes()
    gaps = np.diff(values, prepend=values[:1])
    span = int(values[-1] - values[0]) // n
    k = min(62, max(0, span.bit_length() - 1))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ones = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1, np.uint8)
    unary[ones] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    unary = np.packbits(unary).tobytes()
    return b"".join([np.uint32(n).tobytes(), np.uint8(k).tobytes(), values[:1].tobytes(), np.uint32(len(unary)).tobytes(), unary, np.packbits(rest.ravel()).tobytes()])


def decode(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    if not n:
        return np.zeros(0, np.uint64)
    k = blob[4]
    first = np.frombuffer(blob, np.uint64, 1, 5)[0]
    m = int(np.frombuffer(blob, np.uint32, 1, 13)[0])
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, m, 17)))[:n]
    quotients = np.diff(ones, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=17 + m))[: n * k].reshape(n, k)
    rest = np.zeros(n, np.uint64)
    for b in range(k):
        rest |= bits[:, b].astype(np.uint64) << np.uint64(b)
    return first + np.cumsum((quotients.astype(np.uint64) << np.uint64(k)) | rest)


def owners(values: np.ndarray, n: int) -> np.ndarray:
    """Which of n owners each fingerprint belongs to, by equal ranges; it never falls along sorted values."""
    return ((values >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
