"""Common prefixes of a text's suffixes from its Burrows-Wheeler transform, up to a threshold."""

from __future__ import annotations

import numpy as np

SEPARATOR = 0


def _ranks(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rank of every key, equal ones sharing one."""
    ordered = keys[order]
    step = np.empty(len(keys), np.int64)
    step[0] = 0
    np.cumsum(ordered[1:] != ordered[:-1], out=step[1:])
    ranks = np.empty(len(keys), np.int32)
    ranks[order] = step
    return ranks


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes, ordered by their first `depth` symbols at least; ties stand in any order."""
    n = len(symbols)
    used = np.zeros(257, bool)
    used[symbols] = True
    dense = np.cumsum(used)  # from 1; 0 stands beyond the end
    bits = int(dense[-1]).bit_length()
    reached = 64 // bits
    padded = np.concatenate([dense.astype(np.uint64)[symbols], np.zeros(reached, np.uint64)])
    keys = np.zeros(n, np.uint64)
    for k in range(reached):
        keys = (keys << np.uint64(bits)) | padded[k : k + n]
    order = np.argsort(keys)
    while reached < depth:
        ranks = _ranks(keys, order)
        if int(ranks[order[-1]]) == n - 1:
            break
        keys = ranks.astype(np.uint64) << np.uint64(32)
        keys[: n - reached] |= ranks[reached:].astype(np.uint64) + np.uint64(1)
        order = np.argsort(keys)
        reached *= 2
    return order


def prefix_boundaries(symbols: np.ndarray, order: np.ndarray, threshold: int) -> np.ndarray:
    """Whether each place of the suffix order begins an interval of suffixes with `threshold` common symbols.

    Backward extension of all intervals, breadth first: the interval of cw consists of the places that the
    last-to-first mapping gives to the c in the transform over the interval of w. So the common prefix of two neighbours
    in one c-interval is one longer than the least common prefix between the places they map from. Values are thus
    derived in increasing order, and the expansion stops at the threshold: what has no value by then is as long at least.
    A separator equals nothing.
    """
    n = len(symbols)
    transform = symbols[order - 1]
    # places of each symbol in the transform, in order: the inverse of the last-to-first mapping
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    following = order + 1
    following[following == n] = 0
    source = place[following]
    first = symbols[order]
    begins = np.ones(n, bool)
    begins[1:] = (first[1:] != first[:-1]) | (first[1:] == SEPARATOR)
    del transform, place, following
    source = source.astype(np.intp)
    open_places = np.flatnonzero(~begins)
    above, here = source[open_places - 1], source[open_places]
    interval = np.empty(n, np.int32)
    for _ in range(1, threshold):
        np.cumsum(begins, dtype=np.int32, out=interval)
        differ = interval[above] != interval[here]
        begins[open_places[differ]] = True
        if np.count_nonzero(differ) > len(differ) // 6:  # those that have their value stay different, so they needn't go at once
            same = np.flatnonzero(~differ)
            open_places, above, here = open_places[same], above[same], here[same]
    return begins
