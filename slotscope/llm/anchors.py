"""Least-hash anchors of byte windows: equal windows have equal anchors wherever they stand."""

from __future__ import annotations

import numpy as np

from slotscope.llm.words import BYTE_VALUE, powers

#: Bytes of the strings whose hashes are compared within a window.
GRAM = 24
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def running_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums and factors from which any stretch's hash follows: (sums[j] - sums[i]) * factors[i]."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        values = BYTE_VALUE[data]
        values *= power[:-1]
        np.cumsum(values, out=sums[1:])
    return sums, inverse


def window_anchors(sums: np.ndarray, inverse: np.ndarray, window: int) -> np.ndarray:
    """For each start of a window of so many bytes, the least hash of the GRAM-byte strings in it."""
    if len(sums) <= window:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        least = sums[GRAM:] - sums[:-GRAM]
        least *= inverse[: len(least)]
        least ^= least >> np.uint64(32)  # half of what mix does: which hash is the least, its upper bits decide
        least *= SPREAD
    wide, span = window - GRAM + 1, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    return least


def anchor_runs(offsets: np.ndarray, sums: np.ndarray, inverse: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of window starts with one anchor: row, first start (within data), last start, anchor."""
    anchors = window_anchors(sums, inverse, window)
    lengths = np.diff(offsets)
    rows = np.flatnonzero(lengths >= window)
    if not len(rows) or not len(anchors):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    change = np.ones(len(anchors), bool)
    change[1:] = anchors[1:] != anchors[:-1]
    change[offsets[:-1][rows]] = True
    at = np.flatnonzero(change)
    last = np.append(at[1:], len(anchors)) - 1
    row = np.searchsorted(offsets, at, "right") - 1
    most = offsets[row + 1] - window
    inside = np.flatnonzero(at <= most)  # the others reach over their row's end
    row, at, last = row[inside], at[inside], np.minimum(last, most)[inside]
    return row, at, last, anchors[at]
