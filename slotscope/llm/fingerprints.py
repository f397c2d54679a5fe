"""Which fingerprints several blocks have: sorted Golomb-coded hashes to owners, bitmaps back.

A block sends each of its different fingerprints once, with a bit that tells whether it already holds it twice, and a weight. What
comes back is a bitmap of the fingerprints that are held more than once, and one of those whose weights add up to more than `hot`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from slotscope.llm import golomb
from slotscope.llm.routing import Routes, exchange, in_order

MOST_WEIGHT = 0xFFFF
#: Low bits that stay at home; what then seems equal and isn't costs a look, and no more.
LEFT_OUT = np.uint64(16)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return hashes >> LEFT_OUT << LEFT_OUT


def block_messages(routes: Routes, block: int, values: np.ndarray, several: np.ndarray, weights: np.ndarray, level: int = 1, of: int = 0, group: int | None = None) -> pa.Table:
    """A block's messages about sorted, different fingerprints."""
    press = zstandard.ZstdCompressor(level=1)
    cuts = routes.cuts(values, level, of)
    parts, blobs = [], []
    for k in np.flatnonzero(np.diff(cuts)):
        mine = slice(cuts[k], cuts[k + 1])
        code = golomb.encode(values[mine] >> LEFT_OUT)
        rest = press.compress(np.packbits(several[mine]).tobytes() + np.minimum(weights[mine], MOST_WEIGHT).astype(np.uint16).tobytes())
        parts.append(int(k) + of * routes.fan)
        blobs.append(np.uint32(len(code)).tobytes() + code + rest)
    return routes.messages(block, block if group is None else group, level, parts, blobs)


def _read(blob: bytes, open_up) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int(np.frombuffer(blob, np.uint32, 1)[0])
    values = golomb.decode(blob[4 : 4 + size]) << LEFT_OUT
    rest, n = open_up.decompress(blob[4 + size :]), len(values)
    return values, np.unpackbits(np.frombuffer(rest, np.uint8, (n + 7) // 8))[:n].astype(bool), np.frombuffer(rest, np.uint16, n, (n + 7) // 8)


def _union(messages: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of each message the places of its values among all different ones; these, whether one is held more than once, and its weight."""
    open_up = zstandard.ZstdDecompressor()
    sent = [_read(b, open_up) for b in messages.column("blob").to_pylist()]
    every = np.concatenate([s[0] for s in sent])
    order = np.argsort(every)
    every = every[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    begins, place = np.flatnonzero(new), np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    several = np.logical_or.reduceat(np.concatenate([s[1] for s in sent])[order], begins) | (np.diff(begins, append=len(every)) > 1)
    weights = np.add.reduceat(np.concatenate([s[2] for s in sent])[order].astype(np.int64), begins)
    return np.split(place, np.cumsum([len(s[0]) for s in sent])[:-1]), every[begins], several, weights


def _replies(messages: pa.Table, sent: list[np.ndarray], several: np.ndarray, hot: np.ndarray) -> pa.Table:
    told = [np.packbits(several[at]).tobytes() + np.packbits(hot[at]).tobytes() for at in sent]
    return pa.table({"sender": messages.column("sender"), "part": messages.column("part"), "reply": pa.array(told, pa.binary())})


def read_replies(replies: pa.Table, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The bitmaps of one sender, whose messages had so many values each."""
    several, hot = [np.zeros(0, bool)], [np.zeros(0, bool)]
    for n, blob in zip(sizes, in_order(replies), strict=True):
        bits = np.frombuffer(blob, np.uint8)
        several.append(np.unpackbits(bits[: (n + 7) // 8])[:n].astype(bool))
        hot.append(np.unpackbits(bits[(n + 7) // 8 :])[:n].astype(bool))
    return np.concatenate(several), np.concatenate(hot)


def sizes_of(routes: Routes, values: np.ndarray, level: int = 1, of: int = 0) -> list[int]:
    """How many of the sorted values each message has."""
    return [int(n) for n in np.diff(routes.cuts(values, level, of)) if n]


def held_by_several(messages: DataFrame, routes: Routes, hot: int = MOST_WEIGHT) -> DataFrame:
    """Replies to the blocks' messages."""

    def merge(level: int):
        def merged(rows: pa.Table) -> pa.Table:
            hop = rows.column("to")[0].as_py()
            group, part = routes.place(hop, level)
            _, values, several, weights = _union(rows)
            return block_messages(routes, hop, values, several, weights, level + 1, part, group)

        return merged

    def answer(rows: pa.Table) -> pa.Table:
        sent, _, several, weights = _union(rows)
        return _replies(rows, sent, several, several & (weights > hot))

    def forward(level: int):
        def forwarded(rows: pa.Table, replies: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return pa.table({"sender": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "reply": pa.array([], pa.binary())})
            _, part = routes.place(rows.column("to")[0].as_py(), level)
            sent, values, _, _ = _union(rows)
            return _replies(rows, sent, *read_replies(replies, sizes_of(routes, values, level + 1, part)))

        return forwarded

    return exchange(messages, routes, merge, answer, forward)
