"""An interpolated modified Kneser-Ney bigram model, counted in Spark and stored as sorted hash arrays.

Map tasks count their own bigrams and send them, packed, to shards of gram hashes over hops of bounded fan-out (see routing). A
shard adds them up, writes its grams as sorted arrays, and sends what it has of each word (its uses and the different contexts
before it; as a context, its total and how many grams of it have the counts 1, 2 and more) on to
shards of word hashes, which write the word arrays. A frequent context's grams lie in all shards, and what comes together of
a word is one row a shard. Only counts of counts and the names of the shards come to the driver. Workers map the arrays into
memory and look up the sorted grams of many documents at once.

The arrays' folder has to be a path that all machines mount (the shared folder, as a file: path), since workers
map its files; each task writes its file under another name first, so a task that runs again does no harm. A file that should be
there and isn't raises.

Words and grams are told by 64-bit hashes; counts have 64 bits.
Defined results: null and empty texts are one token, the end; rows that repeat are counted and scored as often as they come;
a null doc_id counts as empty text for the fold; no training rows give every token the same probability.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotscope.llm import golomb
from slotscope.llm.labelled import fold
from slotscope.llm.routing import MESSAGE, Routes, gather, plan_routes
from slotscope.llm.shared import n_parts, new_folder
from slotscope.llm.words import mix, stream, words_of

#: Hashes of the end token, and of what stands before a text; and what makes a gram's hash of its words'.
END, BEGIN, CONTEXT = (stream(3, 41) | np.uint64(1)).tolist()
#: Tokens that a map task counts together, and bytes of text that are scored together.
COUNTED_TOKENS, SCORED_BYTES = 3_000_000, 4 << 20
SHARD_BYTES = 16 << 20
#: What is known of a word: its uses, the different words before it; as a context its total, and its grams with the counts 1, 2 and more.
OF_WORD = ("uses", "lefts", "total", "ones", "twos", "more")


def gram_hash(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(CONTEXT) + words)


def _tokens(column, most_bytes: int):
    """For each chunk: first row, rows, the tokens' words and what stands before each, and where each row's tokens begin and end."""
    for i, n, hashes, ends in words_of(column, most_bytes):
        at = ends + np.arange(n + 1)
        words = np.empty(len(hashes) + n, np.uint64)
        is_end = np.zeros(len(words), bool)
        is_end[at[1:] - 1] = True
        words[~is_end] = hashes
        words[is_end] = END
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[at[:-1]] = BEGIN
        yield i, n, words, before, at


def _pack(columns: list[np.ndarray], press) -> bytes:
    """Columns of numbers of 0 or more, each byte by byte of all its numbers, without the bytes that are 0 in all of them."""
    parts = [np.array([len(columns), *map(len, columns)], np.int64).tobytes()]
    for c in columns:
        c = c.astype(np.uint64)
        width = (int(c.max()).bit_length() + 7) // 8 if len(c) else 0
        parts += [bytes([width]), np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return press.compress(b"".join(parts))


def _unpack(blob: bytes, open_up) -> list[np.ndarray]:
    body = open_up.decompress(blob)
    k = int(np.frombuffer(body, np.int64, 1)[0])
    at, out = 8 * (k + 1), []
    for n in np.frombuffer(body, np.int64, k, 8).tolist():
        width = body[at]
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :width] = np.frombuffer(body, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(whole.view(np.uint64).ravel())
        at += 1 + n * width
    return out


def _begins(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))


def _gram_messages(routes: Routes, sender: int, group: int, level: int, of: int, before: np.ndarray, words: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Messages about different grams: a dictionary of the words that occur, the places in it of context and word, and the counts."""
    press = zstandard.ZstdCompressor(level=1)
    hashes = gram_hash(before, words)
    order = np.argsort(hashes)
    cuts = routes.cuts(hashes[order], level, of)
    parts, blobs = np.flatnonzero(np.diff(cuts)), []
    for k in parts:
        mine = order[cuts[k] : cuts[k + 1]]
        named, place = np.unique(np.concatenate([before[mine], words[mine]]), return_inverse=True)
        u, w = place[: len(mine)], place[len(mine) :]
        nearest = np.argsort(u * len(named) + w)
        blobs.append(_pack([named, np.diff(u[nearest], prepend=0), w[nearest], counts[mine][nearest]], press))
    return routes.messages(sender, group, level, [int(k) + of * routes.fan for k in parts], blobs)


def _grams(messages: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different grams of messages, in the order of their hashes: hash, context, word, count."""
    open_up = zstandard.ZstdDecompressor()
    found = []
    for blob in messages.column("blob").to_pylist():
        named, steps, w, n = _unpack(blob, open_up)
        found.append((named[np.cumsum(steps).astype(np.int64)], named[w.astype(np.int64)], n.astype(np.int64)))
    before, words, counts = (np.concatenate([f[k] for f in found]) for k in range(3))
    hashes = gram_hash(before, words)
    order = np.argsort(hashes)
    first = _begins(hashes[order])
    mine = order[first]
    return hashes[mine], before[mine], words[mine], np.add.reduceat(counts[order], first)


def _count(routes: Routes):
    def different(words: list[np.ndarray], before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        named, place = np.unique(np.concatenate([*words, *before]), return_inverse=True)
        words.clear()
        before.clear()
        half = len(place) // 2
        keys = place[half:].astype(np.int64) * len(named) + place[:half]
        del place
        keys.sort()
        first = _begins(keys)
        keys, counts = keys[first], np.diff(first, append=len(keys))
        return named[keys // len(named)], named[keys % len(named)], counts

    def count(batches):
        sender = TaskContext.get().partitionId() << 24
        words, before, held = [], [], 0
        for batch in batches:
            for _, _, w, u, _ in _tokens(batch.column(0), 1 << 20):
                words.append(w)
                before.append(u)
                held += len(w)
                if held >= COUNTED_TOKENS:
                    yield from _gram_messages(routes, sender, sender, 1, 0, *different(words, before)).to_batches()
                    held, sender = 0, sender + 1
        if held:
            yield from _gram_messages(routes, sender, sender, 1, 0, *different(words, before)).to_batches()

    return count


def _merge_grams(routes: Routes):
    def merge(level: int):
        def merged(messages: pa.Table) -> pa.Table:
            hop = messages.column("to")[0].as_py()
            group, part = routes.place(hop, level)
            _, before, words, counts = _grams(messages)
            return _gram_messages(routes, hop, group, level + 1, part, before, words, counts)

        return merged

    return merge


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Writes an array so that it is there whole or not at all."""
    path = os.path.join(folder, f"{name}.npy")
    partial = f"{path}.{os.getpid()}.part"
    with open(partial, "wb") as f:
        np.save(f, array)
    os.replace(partial, path)


def _least_type(values: np.ndarray) -> np.dtype:
    return np.min_scalar_type(int(values.max()) if len(values) else 0)


def _word_messages(routes: Routes, sender: int, group: int, level: int, of: int, words: np.ndarray, known: list[np.ndarray], of_counts: np.ndarray, shards: np.ndarray) -> pa.Table:
    """Messages about sorted words; the first also has counts of counts and the gram shards that they are of."""
    press = zstandard.ZstdCompressor(level=1)
    cuts = routes.cuts(words, level, of)
    parts, blobs = np.flatnonzero(np.diff(cuts)), []
    for i, k in enumerate(parts):
        mine = slice(cuts[k], cuts[k + 1])
        rest = [of_counts, shards] if i == 0 else [np.zeros(4, np.int64), np.zeros(0, np.int64)]
        blobs.append(_pack([words[mine], *(x[mine] for x in known), *rest], press))
    return routes.messages(sender, group, level, [int(k) + of * routes.fan for k in parts], blobs)


def _words(messages: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """The different words of messages, sorted, with what is known of each added up; counts of counts; gram shards."""
    open_up = zstandard.ZstdDecompressor()
    found = [_unpack(blob, open_up) for blob in messages.column("blob").to_pylist()]
    words = np.concatenate([f[0] for f in found])
    order = np.argsort(words)
    first = _begins(words[order])
    known = [np.add.reduceat(np.concatenate([f[1 + k] for f in found])[order].astype(np.int64), first) for k in range(len(OF_WORD))]
    return words[order][first], known, np.sum([f[-2].astype(np.int64) for f in found], axis=0), np.concatenate([f[-1] for f in found]).astype(np.int64)


def _store_grams(folder: str, routes: Routes):
    """Adds a shard's grams up and writes them; sends what it knows of their words on."""

    def store(messages: pa.Table) -> pa.Table:
        shard = messages.column("to")[0].as_py()
        hashes, before, words, counts = _grams(messages)
        _save(folder, f"gram-{shard}", hashes)
        _save(folder, f"count-{shard}", counts.astype(_least_type(counts)))
        named, place = np.unique(np.concatenate([words, before]), return_inverse=True)
        w, u, n = place[: len(words)], place[len(words) :], len(named)
        known = [np.zeros(n, np.int64) for _ in OF_WORD]
        np.add.at(known[0], w, counts)
        np.add.at(known[2], u, counts)
        for k, of, mine in ((1, w, counts > 0), (3, u, counts == 1), (4, u, counts == 2), (5, u, counts > 2)):
            known[k] = np.bincount(of[mine], minlength=n)
        return _word_messages(routes, shard, shard, 1, 0, named, known, np.bincount(np.minimum(counts, 5), minlength=6)[1:5], np.array([shard]))

    return store


def _merge_words(routes: Routes):
    def merge(level: int):
        def merged(messages: pa.Table) -> pa.Table:
            hop = messages.column("to")[0].as_py()
            group, part = routes.place(hop, level)
            return _word_messages(routes, hop, group, level + 1, part, *_words(messages))

        return merged

    return merge


PARTS = "shard long, n long, tokens long, grams long, of_grams array<long>, of_words array<long>, gram_shards array<long>"


def _store_words(folder: str):
    """Adds a shard's words up and writes them; returns what the driver needs of them."""

    def store(messages: pa.Table) -> pa.Table:
        shard = messages.column("to")[0].as_py()
        words, known, of_grams, gram_shards = _words(messages)
        values = np.zeros(len(words), [(name, _least_type(x)) for name, x in zip(OF_WORD, known, strict=True)])
        for name, x in zip(OF_WORD, known, strict=True):
            values[name] = x
        _save(folder, f"word-{shard}", words)
        _save(folder, f"known-{shard}", values)
        uses, lefts = known[0], known[1]
        of_words = [*np.bincount(np.minimum(lefts, 5), minlength=6)[1:5].tolist(), int(np.sum(lefts > 2))]
        numbers = [shard, int(np.sum(uses > 0)), int(uses.sum()), int(lefts.sum())]
        lists = [of_grams.tolist(), of_words, gram_shards.tolist()]
        return pa.table({n: pa.array([x], t) for n, x, t in zip((c.split()[0] for c in PARTS.split(", ")), numbers + lists, [pa.int64()] * 4 + [pa.list_(pa.int64())] * 3, strict=True)})

    return store


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The modified discounts of counts 1, 2 and over 2, from how many grams have the counts 1 to 4; never below 0 or above the count."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    found = [k + 1 - (k + 2) * y * b / a if a else (k + 1) * y for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)))]
    return tuple(min(max(d, 0.0), k + 1.0) for k, d in enumerate(found))


@dataclass
class Model:
    folder: str
    n_shards: int
    #: The shards that have files.
    gram_shards: frozenset[int] = frozenset()
    word_shards: frozenset[int] = frozenset()
    tokens: int = 0
    n_words: int = 0
    n_grams: int = 0
    gram_discounts: tuple = (0.0, 0.0, 0.0)
    word_discounts: tuple = (0.0, 0.0, 0.0)
    #: The share that words leave to what is unknown.
    left: float = 1.0
    _arrays: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_arrays": {}}

    def array(self, name: str, shard: int) -> np.ndarray:
        """A stored array, mapped into memory."""
        key = (name, shard)
        if key not in self._arrays:
            self._arrays[key] = np.load(os.path.join(self.folder, f"{name}-{shard}.npy"), mmap_mode="r")
        return self._arrays[key]

    def find(self, keys: str, values: str, shards: frozenset[int], wanted: np.ndarray):
        """For each shard with some of the sorted hashes: where they stand among those wanted, and the shard's values for them."""
        ends = np.searchsorted(golomb.owners(wanted, self.n_shards), np.arange(self.n_shards + 1))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            if k in shards:
                known, mine = self.array(keys, k), wanted[ends[k] : ends[k + 1]]
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                hit = np.flatnonzero(known[at] == mine)
                yield ends[k] + hit, self.array(values, k)[at[hit]]

    def log_probabilities(self, words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token its log10 probability after the word before it, and its count in training."""
        named, place = np.unique(np.concatenate([words, before]), return_inverse=True)
        w, u = place[: len(words)], place[len(words) :]
        uses, lefts, total, ones, twos, more = known = [np.zeros(len(named), np.int64) for _ in OF_WORD]
        for at, values in self.find("word", "known", self.word_shards, named):
            for x, name in zip(known, OF_WORD, strict=True):
                x[at] = values[name]
        grams, gram = np.unique(gram_hash(before, words), return_inverse=True)
        counts = np.zeros(len(grams), np.int64)
        for at, values in self.find("gram", "count", self.gram_shards, grams):
            counts[at] = values
        d = np.array([0.0, *self.word_discounts])
        single = np.maximum(lefts - d[np.minimum(lefts, 3)], 0) / max(self.n_grams, 1) + self.left / (self.n_words + 1)
        d = np.array([0.0, *self.gram_discounts])
        seen = np.maximum(total, 1)
        share = np.where(total > 0, (ones * d[1] + twos * d[2] + more * d[3]) / seen, 1.0)
        c = counts[gram]
        p = np.where(total[u] > 0, np.maximum(c - d[np.minimum(c, 3)], 0) / seen[u], 0.0) + share[u] * single[w]
        return np.log10(p), uses[w]


def local_path(folder: str) -> str:
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the language model's arrays are mapped into memory and need a mounted folder, not {folder}")
    return unquote(parts.path)


def train(docs: DataFrame, folder: str) -> Model:
    """A model of all docs' texts, its arrays in folder."""
    n = n_parts(docs, SHARD_BYTES)
    routes = plan_routes(n, n)
    path = local_path(folder)
    os.makedirs(path, exist_ok=True)
    grams = docs.select("text").mapInArrow(_count(routes), MESSAGE)
    words = gather(grams, routes, _merge_grams(routes), _store_grams(path, routes), MESSAGE)
    parts = gather(words, routes, _merge_words(routes), _store_words(path), PARTS).collect()  # a row a shard
    total = lambda c: sum(r[c] for r in parts)
    each = lambda c, k: [sum(r[c][i] for r in parts) for i in range(k)]
    of_words = each("of_words", 5)
    shards = frozenset(k for r in parts for k in r["gram_shards"])
    model = Model(path, routes.fan**routes.levels, shards, frozenset(r["shard"] for r in parts), total("tokens"), total("n"), total("grams"), discounts(each("of_grams", 4)), discounts(of_words[:4]))
    if model.n_grams:
        d = model.word_discounts
        model.left = (d[0] * of_words[0] + d[1] * of_words[1] + d[2] * of_words[4]) / model.n_grams
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each of docs (doc_id, text, held_out)."""

    def scores(batches):
        base = np.log10(model.tokens + model.n_words + 1)
        for batch in batches:
            out = [np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, float, float)]
            for i, n, words, before, at in _tokens(batch.column("text"), SCORED_BYTES):
                logs, uses = model.log_probabilities(words, before)
                for target, values in zip(out, (np.ones(len(words), np.int64), (uses > 0).astype(np.int64), np.log10(uses + 1) - base, logs), strict=True):
                    target[i : i + n] = np.add.reduceat(values, at[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(x) for x in out[:2]), pa.array(np.full(batch.num_rows, model.tokens, np.int64)), *(pa.array(x) for x in out[2:])], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def language_model(docs: DataFrame, n_folds: int = 7, held_fold: int = 2) -> DataFrame:
    """Scores all docs by a model of those outside the held fold, with perplexity."""
    marked = docs.select("doc_id", "text", (fold("doc_id", n_folds) == held_fold).alias("held_out"))
    model = train(marked.where(~F.col("held_out")), new_folder(docs.sparkSession, "language-model"))
    return score(marked, model).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
