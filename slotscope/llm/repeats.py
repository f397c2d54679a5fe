"""Suffix-array deduplication: bytes covered by strings that a document of smaller id has too.

Equal windows of `threshold` bytes have equal anchors, so windows are kept together by anchor: stretches of window starts
with one anchor travel as one string. First the anchors that more than one document has are found, by an exchange of
Golomb-coded fingerprints between blocks of documents and owners. Each block then sends every different string of these
once, with the smallest doc_id that has it. Where strings of the same anchors meet, their Burrows-Wheeler
transform is made and threshold-bounded interval expansion gives the intervals of equal windows; each interval's
smallest doc_id goes back to the blocks, which mark the bytes. Blocks stand in for documents throughout, so a passage
that many documents share is one string a block, and one string a hop on the way (see routing).

An anchor around which very many different strings stand, as in a line that everybody writes, is split: its windows
travel one by one and meet by the hash of all their bytes.

Texts of a small vocabulary share ever more anchors by chance as they grow in number, without sharing a window. Windows that
have no other string's window's hash at their anchor are left out of the transform: there a string's own smallest doc_id is the
answer. Of the passages that remain, equal ones are transformed once.

Defined results: null text has no bytes; texts shorter than the threshold lose nothing; rows of one doc_id never lose
bytes to each other; a null doc_id is larger than all others; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotscope.llm import routing
from slotscope.llm.anchors import anchor_runs, running_hash
from slotscope.llm.bwt import SEPARATOR, prefix_boundaries, suffix_order
from slotscope.llm.fingerprints import block_messages, fingerprint, held_by_several, read_replies, sizes_of
from slotscope.llm.routing import MESSAGE, Routes, exchange, in_order, plan_routes
from slotscope.llm.shared import chunks, n_parts, utf8_column
from slotscope.llm.words import mix

LAST_ID = np.iinfo(np.int64).max
#: Bytes of text that a block's anchors are made for at once.
CHUNK_BYTES = 1 << 16
#: Symbols that are sorted together, few enough for the cache.
SORTED_SYMBOLS = 120_000
#: Bytes of strings whose windows are compared by hash at once.
SIFTED_BYTES = 1 << 18
#: Stored bytes of a block of documents.
BLOCK_BYTES = 8 << 20
#: Different strings of an anchor, counted by block, above which its windows are split; a block counts exactly from COUNTED on.
HOT_STRINGS, COUNTED = 8192, 16
#: Stretches whose bytes are compared at once.
COMPARED = 1 << 15

RESULT = "doc_id long, row_key long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"


def _ids(column) -> np.ndarray:
    return column.combine_chunks().fill_null(int(LAST_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(data: np.ndarray, offsets: np.ndarray, threshold: int):
    """For each chunk of a block: row, first and last window start, and anchor of all stretches, a hash of each one's bytes, and the chunk's hashes."""
    for i, j in chunks(offsets, CHUNK_BYTES):
        base = offsets[i]
        sums, inverse = running_hash(data[base : offsets[j]])
        row, first, last, anchor = anchor_runs(offsets[i : j + 1] - base, sums, inverse, threshold)
        # least hashes gather at the low end of their range; mixed, they fill it evenly
        whole = mix((sums[last + threshold] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
        yield row + i, first + base, last + base, mix(anchor ^ np.uint64(29)), whole


def _begins(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return new


def _spread(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The indexes starts[i] ... starts[i] + counts[i] - 1, for all i in a row."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _meeting(anchors: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """What strings are sorted by: the upper halves of their anchors, and of hashes of their bytes."""
    return anchors >> np.uint64(32) << np.uint64(32) | hashes >> np.uint64(32)


def _told_apart(data: np.ndarray, first: np.ndarray, size: np.ndarray, new: np.ndarray) -> np.ndarray:
    """new, which begins runs of strings that are held to be equal, where strings that differ from their run's first one begin runs of their own."""
    leader = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    others = np.flatnonzero(~new)
    for at in range(0, len(others), COMPARED):
        mine = others[at : at + COMPARED]
        n, m = size[mine], size[leader[mine]]
        both = np.minimum(n, m)
        differ = data[_spread(both, first[mine])] != data[_spread(both, first[leader[mine]])]
        wrong = mine[np.logical_or.reduceat(differ, np.cumsum(both) - both) | (n != m)]
        new[wrong] = True
        after = wrong[wrong + 1 < len(new)] + 1
        new[after] = True
    return new


def _ask(routes: Routes, threshold: int):
    """Sends a block's anchors to their owners: whether several of its documents have one, and how many different strings stand around it."""

    def ask(rows: pa.Table) -> pa.Table:
        data, offsets = utf8_column(rows.column("text"))
        ids = _ids(rows.column("doc_id"))
        kept = [(fingerprint(anchor), ids[row], whole) for row, _, _, anchor, whole in _runs(data, offsets, threshold)]
        sent, doc, whole = (np.concatenate([*(x[k] for x in kept), np.zeros(0, t)]) for k, t in enumerate((np.uint64, np.int64, np.uint64)))
        order = np.argsort(sent)
        sent, doc, whole = sent[order], doc[order], whole[order]
        begins = np.flatnonzero(_begins(sent))
        n = np.diff(begins, append=len(sent))
        several = np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins) if len(begins) else np.zeros(0, bool)
        weights = np.minimum(n, COUNTED)
        many = np.flatnonzero(n > COUNTED)
        if len(many):
            place, of = _spread(n[many], begins[many]), np.repeat(np.arange(len(many)), n[many])
            strings = whole[place][np.lexsort((whole[place], of))]
            weights[many] = np.bincount(of[_begins(of, strings)], minlength=len(many))
        return block_messages(routes, rows.column("block")[0].as_py(), sent[begins], several, weights)

    return ask


class _Block:
    """A block's stretches whose anchors several documents have, and its different strings in the order of their anchors."""

    def __init__(self, rows: pa.Table, answers: pa.Table, routes: Routes, threshold: int):
        self.data, self.offsets = utf8_column(rows.column("text"))
        self.ids = _ids(rows.column("doc_id"))
        parts = list(_runs(self.data, self.offsets, threshold))
        sent = np.concatenate([*(fingerprint(p[3]) for p in parts), np.zeros(0, np.uint64)])
        order = np.argsort(sent)
        begins = _begins(sent[order])
        several, hot = read_replies(answers, sizes_of(routes, sent[order[begins]]))
        of = np.empty(len(sent), np.int64)
        of[order] = np.cumsum(begins) - 1
        del sent, order, begins
        found, at = [], 0
        for part in parts:
            mine = of[at : at + len(part[0])]
            at += len(mine)
            keep = np.flatnonzero(several[mine])
            found.append(self._windows([x[keep] for x in part], hot[mine[keep]], threshold))
        del parts, of
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
        row, first, last, anchor, whole = (np.concatenate([*(f[k] for f in found), np.zeros(0, t)]) for k, t in enumerate(kinds))
        met = _meeting(anchor, whole)
        order = np.argsort(met)
        self.row, self.first, self.last, self.anchor = (x[order] for x in (row, first, last, anchor))
        new = self._verified(_begins(met[order]), threshold)
        #: Of each stretch, its string; of each string, its first stretch and its smallest doc_id.
        self.string = np.cumsum(new) - 1
        self.leader = np.flatnonzero(new)
        self.least = np.minimum.reduceat(self.ids[self.row], self.leader) if len(new) else np.zeros(0, np.int64)

    def _windows(self, part: list[np.ndarray], hot: np.ndarray, threshold: int) -> list[np.ndarray]:
        """The stretches, those of hot anchors window by window, with a hash of the whole window as their anchor."""
        if not hot.any():
            return part
        row, first, last, _, _ = (x[hot] for x in part)
        n = last - first + 1
        start = _spread(n, first)
        base, stop = int(first.min()), int(last.max()) + threshold
        sums, inverse = running_hash(self.data[base:stop])
        whole = mix((sums[start - base + threshold] - sums[start - base]) * inverse[start - base])
        single = [np.repeat(row, n), start, start, mix(whole ^ np.uint64(31)), whole]
        return [np.concatenate([x[~hot], y]) for x, y in zip(part, single, strict=True)]

    def _verified(self, new: np.ndarray, threshold: int) -> np.ndarray:
        """new, where stretches that don't have their string's bytes, however equal their hashes, are strings of their own."""
        return _told_apart(self.data, self.first, self.last - self.first + threshold, new)


#: A message of strings: how many there are; of each the upper half of its anchor, its smallest doc_id and its length; and their bytes.
def _pack(anchors: np.ndarray, ids: np.ndarray, lengths: np.ndarray, body: list[bytes], press) -> bytes:
    high = (anchors >> np.uint64(32)).astype(np.uint32)
    return press.compress(b"".join([np.array([len(ids)], np.int64).tobytes(), np.diff(high, prepend=np.uint32(0)).tobytes(), ids.tobytes(), lengths.astype(np.int32).tobytes(), *body]))


def _send(routes: Routes, threshold: int):
    def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return routes.messages(0, 0, 1, [], [])
        parts, blobs, press = [], [], zstandard.ZstdCompressor(level=1)
        block = _Block(rows, answers, routes, threshold)
        anchor = block.anchor[block.leader]
        cuts = routes.cuts(anchor, 1)
        for k in np.flatnonzero(np.diff(cuts)):
            mine = block.leader[cuts[k] : cuts[k + 1]]
            first, size = block.first[mine], block.last[mine] + threshold - block.first[mine]
            parts.append(int(k))
            blobs.append(_pack(anchor[cuts[k] : cuts[k + 1]], block.least[cuts[k] : cuts[k + 1]], size, [block.data[_spread(size, first)].tobytes()], press))
        name = rows.column("block")[0].as_py()
        return routes.messages(name, name, 1, parts, blobs)

    return send


class _Strings:
    """The different strings of several messages, in the order of their anchors, each with its smallest doc_id.

    Messages are read in the order of their senders, so that a hop which reads its messages again meets the same order, however they arrive.
    Two that are equal may stand apart, if another one with their hash stands between them; they then are two strings of one anchor.
    """

    def __init__(self, messages: pa.Table):
        self.messages = messages = messages.sort_by("sender")
        open_up = zstandard.ZstdDecompressor()
        parts = []
        for blob in messages.column("blob"):
            body = open_up.decompress(blob.as_buffer())
            n = int(np.frombuffer(body, np.int64, 1)[0])
            high = np.cumsum(np.frombuffer(body, np.uint32, n, 8), dtype=np.uint32)
            parts.append((high, np.frombuffer(body, np.int64, n, 8 + 4 * n), np.frombuffer(body, np.int32, n, 8 + 12 * n), np.frombuffer(body, np.uint8, offset=8 + 16 * n)))
        high, ids, lengths, self.data = (np.concatenate([p[k] for p in parts]) for k in range(4))
        counts = [len(p[0]) for p in parts]
        del parts
        lengths = lengths.astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        hashes = np.empty(len(ids), np.uint64)
        for i, j in chunks(offsets, CHUNK_BYTES):
            at = offsets[i : j + 1] - offsets[i]
            sums, inverse = running_hash(self.data[offsets[i] : offsets[j]])
            hashes[i:j] = mix((sums[at[1:]] - sums[at[:-1]]) * inverse[at[:-1]] + lengths[i:j].astype(np.uint64))
        met = _meeting(high.astype(np.uint64) << np.uint64(32), hashes)
        order = np.argsort(met)
        new = _told_apart(self.data, offsets[order], lengths[order], _begins(met[order]))
        begins = np.flatnonzero(new)
        leader = order[begins]
        self.first, self.lengths, self.anchors = offsets[leader], lengths[leader], high[leader].astype(np.uint64) << np.uint64(32)
        self.ids = np.minimum.reduceat(ids[order], begins)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        #: Of each message, its strings.
        self.sent = np.split(place, np.cumsum(counts)[:-1])

    def bytes_of(self, which: slice | np.ndarray) -> np.ndarray:
        """The bytes of some strings, one after the other."""
        return self.data[_spread(self.lengths[which], self.first[which])]

    @property
    def strings(self) -> list[bytes]:
        return [self.data[i : i + n].tobytes() for i, n in zip(self.first, self.lengths, strict=True)]

    def answered(self, runs: _Runs) -> pa.Table:
        """Replies to the messages with the runs of each one's strings."""
        press = zstandard.ZstdCompressor(level=1)
        return pa.table({"sender": self.messages.column("sender"), "part": self.messages.column("part"), "reply": pa.array([runs.of(m).packed(press) for m in self.sent], pa.binary())})


class _Runs:
    """For each of a row of strings, runs of windows (each up to a place within the string) and the smallest doc_id that has these windows."""

    def __init__(self, counts: np.ndarray, stops: np.ndarray, values: np.ndarray):
        self.counts, self.stops, self.values = counts, stops, values
        self.begins = np.cumsum(counts) - counts

    def of(self, strings: np.ndarray) -> _Runs:
        place = _spread(self.counts[strings], self.begins[strings])
        return _Runs(self.counts[strings], self.stops[place], self.values[place])

    def packed(self, press) -> bytes:
        return press.compress(b"".join([np.array([len(self.counts), len(self.stops)], np.int64).tobytes(), self.counts.astype(np.int32).tobytes(), self.stops.astype(np.int32).tobytes(), self.values.astype(np.int64).tobytes()]))

    @staticmethod
    def read(replies: list[bytes]) -> _Runs:
        open_up = zstandard.ZstdDecompressor()
        parts: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        for blob in replies:
            body = open_up.decompress(blob)
            m, r = (int(x) for x in np.frombuffer(body, np.int64, 2))
            parts.append((np.frombuffer(body, np.int32, m, 16), np.frombuffer(body, np.int32, r, 16 + 4 * m), np.frombuffer(body, np.int64, r, 16 + 4 * m + 4 * r)))
        return _Runs(*(np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(3)))


def _smallest(data: np.ndarray, lengths: np.ndarray, ids: np.ndarray, threshold: int) -> np.ndarray:
    """For each window of the strings, one after the other in data, the smallest id among the strings in which it occurs."""
    ends = np.cumsum(lengths + 1)
    symbols = np.full(len(data) + len(lengths), SEPARATOR, np.uint16)
    solid = np.ones(len(symbols), bool)
    solid[ends - 1] = False
    symbols[solid] = data.astype(np.uint16) + np.uint16(1)
    begins = ends - lengths - 1
    n_windows = lengths - threshold + 1
    owner = np.repeat(np.arange(len(lengths)), n_windows)
    number = np.full(len(symbols), -1, np.int64)
    number[np.repeat(begins, n_windows) + np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)] = np.arange(len(owner))
    order = suffix_order(symbols, threshold)
    interval = np.cumsum(prefix_boundaries(symbols, order, threshold))
    windows = number[order]
    at = np.flatnonzero(windows >= 0)
    windows, interval = windows[at], interval[at]
    cuts = np.flatnonzero(np.diff(interval, prepend=-1))
    least = np.minimum.reduceat(ids[owner[windows]], cuts)
    out = np.empty(len(owner), np.int64)
    out[windows] = np.repeat(least, np.diff(cuts, append=len(windows)))
    return out


def _pieces(anchors: np.ndarray, room: np.ndarray, most: int):
    """Slices of whole anchors' strings, each with as many as have that room together, one anchor at least."""
    groups, room, at = np.flatnonzero(np.append(_begins(anchors), True)), np.cumsum(room), 0
    while at < len(groups) - 1:
        i = groups[at]
        enough = np.searchsorted(room, (room[i - 1] if i else 0) + most)
        at = max(at + 1, int(np.searchsorted(groups, enough, "right")) - 1)
        yield slice(i, groups[at])


def _sifted(data: np.ndarray, first: np.ndarray, lengths: np.ndarray, anchors: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """The strings that aren't alone at their anchor and have windows of the hash of another one; their first and last such window, and a hash of the passage between."""
    begins = np.flatnonzero(_begins(anchors))
    sizes = np.diff(begins, append=len(anchors))
    several = np.flatnonzero(np.repeat(sizes > 1, sizes))
    found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    for piece in _pieces(anchors[several], lengths[several], SIFTED_BYTES):
        mine = several[piece]
        size = lengths[mine]
        n, base = size - threshold + 1, np.cumsum(size) - size
        sums, inverse = running_hash(data[_spread(size, first[mine])])
        at, of = _spread(n, base), np.repeat(np.arange(len(mine)), n)
        hashes = (sums[at + threshold] - sums[at]) * inverse[at]
        order = np.argsort(hashes)
        same = hashes[order[1:]] == hashes[order[:-1]]
        twice = np.zeros(len(hashes), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hits = np.flatnonzero(twice)
        change = np.flatnonzero(_begins(of[hits]))
        string = of[hits[change]]
        i, j = at[hits[change]], at[hits[np.append(change[1:], len(hits)) - 1]] if len(hits) else at[hits]
        found.append((mine[string], i - base[string], j - base[string], mix((sums[j + threshold] - sums[i]) * inverse[i] + (j - i).astype(np.uint64))))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(4))


def _transformed(data: np.ndarray, first: np.ndarray, lengths: np.ndarray, anchors: np.ndarray, ids: np.ndarray, threshold: int) -> _Runs:
    """Runs of the strings, in the order of their anchors; a string has one, with its own doc_id, unless the transform gives it others."""
    n_windows = lengths - threshold + 1
    n_runs = np.ones(len(ids), np.int64)
    alike = _sifted(data, first, lengths, anchors, threshold)[0]
    counts, stops, values = [], [], []
    for piece in _pieces(anchors[alike], lengths[alike] + 1, SORTED_SYMBOLS):
        part = alike[piece]
        least = _smallest(data[_spread(lengths[part], first[part])], lengths[part], ids[part], threshold)
        ends = np.cumsum(n_windows[part])
        change = _begins(least)
        change[ends - n_windows[part]] = True
        places = np.flatnonzero(change)
        of = np.searchsorted(ends, places, "right")
        counts.append(np.bincount(of, minlength=len(ends)))
        values.append(least[places])
        stops.append(np.append(places[1:], len(least)) - (ends - n_windows[part])[of])
    n_runs[alike] = np.concatenate([*counts, np.zeros(0, np.int64)])
    runs = _Runs(n_runs, np.repeat(n_windows, n_runs), np.repeat(ids, n_runs))
    at = _spread(n_runs[alike], runs.begins[alike])
    runs.stops[at], runs.values[at] = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (stops, values))
    return runs


def _expand(threshold: int):
    def expand(messages: pa.Table) -> pa.Table:
        """Answers each message's strings with runs of windows and the smallest doc_id that has these windows."""
        met = _Strings(messages)
        which, since, last, hashes = _sifted(met.data, met.first, met.lengths, met.anchors, threshold)
        # many strings have one passage in common and nothing else, as at the edges of a line: it is transformed once
        size, start = last - since + threshold, met.first[which] + since
        meeting = _meeting(met.anchors[which], hashes)
        order = np.argsort(meeting)
        new = _told_apart(met.data, start[order], size[order], _begins(meeting[order]))
        begins = np.flatnonzero(new)
        lead = order[begins]
        least = np.minimum.reduceat(met.ids[which][order], begins) if len(begins) else np.zeros(0, np.int64)
        found = _transformed(met.data, start[lead], size[lead], met.anchors[which][lead], least, threshold)
        passage = np.empty(len(which), np.int64)
        passage[order] = np.cumsum(new) - 1
        # before and after its passage a string's windows are its own
        n_windows = met.lengths - threshold + 1
        before, after = since > 0, last < n_windows[which] - 1
        n_runs = np.ones(len(met.ids), np.int64)
        n_runs[which] = before + found.counts[passage] + after
        runs = _Runs(n_runs, np.repeat(n_windows, n_runs), np.repeat(met.ids, n_runs))
        runs.stops[runs.begins[which[before]]] = since[before]
        n = found.counts[passage]
        at, place = _spread(n, runs.begins[which] + before), _spread(n, found.begins[passage])
        runs.stops[at], runs.values[at] = found.stops[place] + np.repeat(since, n), found.values[place]
        return met.answered(runs)

    return expand


def _merge(routes: Routes):
    def merge(level: int):
        def merged(messages: pa.Table) -> pa.Table:
            """A hop's different strings, written on."""
            hop = messages.column("to")[0].as_py()
            group, part = routes.place(hop, level)
            met, press = _Strings(messages), zstandard.ZstdCompressor(level=1)
            cuts = routes.cuts(met.anchors, level + 1, part)
            found = np.flatnonzero(np.diff(cuts))
            pieces = [slice(cuts[k], cuts[k + 1]) for k in found]
            blobs = [_pack(met.anchors[p], met.ids[p], met.lengths[p], [met.bytes_of(p).tobytes()], press) for p in pieces]
            return routes.messages(hop, group, level + 1, [int(k) + part * routes.fan for k in found], blobs)

        return merged

    return merge


def _forward(level: int):
    def forwarded(messages: pa.Table, replies: pa.Table) -> pa.Table:
        if not messages.num_rows:
            return pa.table({"sender": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "reply": pa.array([], pa.binary())})
        return _Strings(messages).answered(_Runs.read(in_order(replies)))

    return forwarded


def _mark(routes: Routes, threshold: int):
    def mark(rows: pa.Table, answers: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(rows, answers, routes, threshold)
        found = _Runs.read(in_order(replies))
        counts, begins, stops, values = found.counts, found.begins, found.stops, found.values
        delta = np.zeros(len(block.data) + 1, np.int32)
        step = 1 << 18
        for at in range(0, len(block.string), step):
            string = block.string[at : at + step]
            runs = _spread(counts[string], begins[string])
            stretch = np.repeat(np.arange(at, at + len(string)), counts[string])
            since = np.where(runs == begins[block.string[stretch]], 0, stops[runs - 1])
            removed = values[runs] < block.ids[block.row[stretch]]
            np.add.at(delta, (block.first[stretch] + since)[removed], 1)
            np.add.at(delta, (block.first[stretch] + stops[runs] + threshold - 1)[removed], -1)
        gone = np.cumsum(delta[:-1], dtype=np.int32) > 0
        del delta
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        row_starts = block.offsets[:-1][block.offsets[:-1] < len(gone)]
        edge[row_starts] = gone[row_starts]
        last = gone.copy()
        last[:-1] &= ~gone[1:]
        row_ends = block.offsets[1:][block.offsets[1:] > 0] - 1
        last[row_ends] = gone[row_ends]
        starts, stops = np.flatnonzero(edge), np.flatnonzero(last) + 1
        of = np.searchsorted(block.offsets, starts, "right") - 1
        spans = pa.StructArray.from_arrays([pa.array((starts - block.offsets[of]).astype(np.int32)), pa.array((stops - block.offsets[of]).astype(np.int32))], ["start", "end"])
        span_ends = np.searchsorted(starts, block.offsets).astype(np.int32)
        lost = np.bincount(of, stops - starts, len(block.ids)).astype(np.int64)
        kept_ends = np.concatenate([[0], np.cumsum(np.diff(block.offsets) - lost)]).astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(block.ids), [None, pa.py_buffer(kept_ends), pa.py_buffer(np.ascontiguousarray(block.data[~gone]))])
        return pa.table({"doc_id": rows.column("doc_id"), "row_key": rows.column("row_key"), "n_bytes": pa.array(np.diff(block.offsets)), "spans": pa.ListArray.from_arrays(pa.array(span_ends), spans), "kept": kept})

    return mark


def remove_repeats(docs: DataFrame, threshold: int = 50) -> DataFrame:
    """A row for each document: doc_id, row_key, n_bytes, the removed spans (byte offsets in the text) and the kept bytes."""
    n = n_parts(docs, BLOCK_BYTES)
    # a range takes what two blocks send, and more messages cost less than a hop: there is none up to 1,024 blocks
    routes = plan_routes(n, n // 2, routing.FAN**2 // 32)
    key = F.xxhash64("doc_id", "text")
    blocks = docs.select("doc_id", "text", key.alias("row_key"), F.pmod(F.xxhash64(key), F.lit(n)).alias("block")).groupBy("block")
    answers = held_by_several(blocks.applyInArrow(_ask(routes, threshold), MESSAGE), routes, HOT_STRINGS)
    strings = blocks.cogroup(answers.groupBy("sender")).applyInArrow(_send(routes, threshold), MESSAGE)
    replies = exchange(strings, routes, _merge(routes), _expand(threshold), _forward)
    # both kinds of answer reach their block together
    told = answers.withColumn("kind", F.lit(0)).unionByName(replies.withColumn("kind", F.lit(1)))
    mark = _mark(routes, threshold)

    def conclude(rows: pa.Table, said: pa.Table) -> pa.Table:
        kind = said.column("kind")
        return mark(rows, said.filter(pc.equal(kind, 0)), said.filter(pc.equal(kind, 1)))

    return blocks.cogroup(told.groupBy("sender")).applyInArrow(conclude, RESULT)
