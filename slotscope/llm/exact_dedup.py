"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Each map task groups its own texts byte by byte and keeps one representative a text. The representatives'
fingerprints go, sorted and Golomb-coded, to the owners of fingerprint ranges; owners answer each block with a
bitmap of those that other blocks have too. Only the representatives so marked, and what little a Bloom filter of their rows
lets through besides, are shuffled with their text for a comparison of their bytes. A group of copies of any size
thus sends one row a block, never one a copy.

Defined results: a null text equals the empty one; every input row gives a row; rows that repeat both doc_id and
text are one document and stay or go together; a null doc_id loses to any other id of as long a text; no rows give
no rows; other columns are not read. keep_one leaves one row of each group: of those that repeat both, the one whose
columns have the smallest hash, and of null ids the one of the smallest key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotscope.llm.fingerprints import block_messages, fingerprint, held_by_several, read_replies, sizes_of
from slotscope.llm.routing import MESSAGE, Routes, plan_routes
from slotscope.llm.shared import KeyFilter, cut, free_name, keep_row, n_parts

BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of text that a map task holds at once to group its copies; then it begins another block.
BLOCK_BYTES = 24 << 20

SLIM = "doc_id long, row_key long, block long, n_points long, sha binary"


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, BLANKS)


def _fingerprints(shas: pa.ChunkedArray) -> np.ndarray:
    """A block's different fingerprints, sorted."""
    return np.unique(fingerprint(np.frombuffer(b"".join(s[:8] for s in shas.to_pylist()), ">u8").astype(np.uint64)))


def _slim(batches):
    """Per document: its block, and the SHA-256 of its normalised text, made once for each text of a block."""
    base = TaskContext.get().partitionId() << 24
    seen: dict[bytes, bytes] = {}
    held = 0
    for batch in batches:
        texts, shas, blocks = batch.column("text"), [], []
        for scalar in texts:
            body = normalised(scalar.as_py())
            if (sha := seen.get(body)) is None:
                if held > BLOCK_BYTES:
                    seen, held, base = {}, 0, base + 1
                sha = seen[body] = hashlib.sha256(body).digest()
                held += len(body) + 200
            shas.append(sha)
            blocks.append(base)
        points = pc.fill_null(pc.cast(pc.utf8_length(texts), pa.int64()), 0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(blocks, pa.int64()), points, pa.array(shas, pa.binary())], ["doc_id", "row_key", "block", "n_points", "sha"])


def _send(routes: Routes):
    def send(rows: pa.Table) -> pa.Table:
        values = _fingerprints(rows.column("sha"))
        return block_messages(routes, rows.column("block")[0].as_py(), values, np.zeros(len(values), bool), np.ones(len(values), np.int64))

    return send


def _rank(points: int, doc_id: int | None, key: int) -> tuple:
    """Longer first, then the smaller id; a null id comes last."""
    return (-points, doc_id is None, doc_id or 0, key)


def _local_groups(rows: pa.Table) -> dict[bytes, list]:
    """By SHA: count, code points, doc_id and row key of the block's best row."""
    groups: dict[bytes, list] = {}
    for sha, points, doc_id, key in zip(*(rows.column(c).to_pylist() for c in ("sha", "n_points", "doc_id", "row_key")), strict=True):
        if (g := groups.get(sha)) is None:
            groups[sha] = [1, points, doc_id, key]
        else:
            g[0] += 1
            if _rank(points, doc_id, key) < _rank(*g[1:]):
                g[1:] = points, doc_id, key
    return groups


def _suspects(routes: Routes):
    """One representative for each of the block's texts that another block may have too."""

    def suspects(rows: pa.Table, answers: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows:
            values = _fingerprints(rows.column("sha"))
            several, _ = read_replies(answers, sizes_of(routes, values))
            shared = {int(v).to_bytes(8, "big")[:6] for v in values[several]}
            block = rows.column("block")[0].as_py()
            found = [(s, *g, block) for s, g in _local_groups(rows).items() if s[:6] in shared]
        names = ("sha", "n_local", "n_points", "best_id", "row_key", "block")
        columns = list(zip(*found, strict=True)) or [[]] * len(names)
        return pa.table({n: pa.array(list(c), pa.binary() if n == "sha" else pa.int64()) for n, c in zip(names, columns, strict=True)})

    return suspects


def _bodies(wanted):
    """The texts of the rows that the filter lets through, compressed, with their SHAs; a task's repeats once."""

    def bodies(batches):
        press, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            out = []
            for i in np.flatnonzero(wanted.value.has(keys)).tolist():
                text = batch.column("text")[i].as_py()
                sha = hashlib.sha256(normalised(text)).digest()
                if (keys[i], sha) not in seen:
                    seen.add((keys[i], sha))
                    out.append((int(keys[i]), sha, press.compress(normalised(text))))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["row_key", "sha", "body"])

    return bodies


def _verify(rows: pa.Table) -> pa.Table:
    """Groups representatives whose bytes are equal; tells each block the row that stays and the group's size."""
    open_up = zstandard.ZstdDecompressor()
    groups: dict[bytes, list] = {}
    for sha, block, n, points, doc_id, key, body in zip(*(rows.column(c).to_pylist() for c in ("sha", "block", "n_local", "n_points", "best_id", "row_key", "body")), strict=True):
        g = groups.setdefault(open_up.decompress(body), [0, None, sha, []])
        g[0] += n
        g[3].append(block)
        if g[1] is None or _rank(points, doc_id, key) < _rank(*g[1]):
            g[1] = (points, doc_id, key)
    out = [(b, g[2], g[1][1], g[1][2], g[0]) for g in groups.values() for b in g[3]]
    columns = list(zip(*out, strict=True)) or [[]] * 5
    return pa.table({n: pa.array(list(c), pa.binary() if n == "sha" else pa.int64()) for n, c in zip(("block", "sha", "keep_id", "keep_key", "group_size"), columns, strict=True)})


def _conclude(rows: pa.Table, verified: pa.Table) -> pa.Table:
    final = {s: (k, key, n) for s, k, key, n in zip(*(verified.column(c).to_pylist() for c in ("sha", "keep_id", "keep_key", "group_size")), strict=True)}
    for sha, (n, _, doc_id, key) in _local_groups(rows).items():
        final.setdefault(sha, (doc_id, key, n))
    shas, ids, keys = (rows.column(c).to_pylist() for c in ("sha", "doc_id", "row_key"))
    got = [final[s] for s in shas]
    keep = [k == d for (k, _, _), d in zip(got, ids, strict=True)]
    stays = [k and key == mine for k, (_, key, _), mine in zip(keep, got, keys, strict=True)]
    return pa.table({
        "doc_id": rows.column("doc_id"), "keep_id": pa.array([g[0] for g in got], pa.int64()), "group_size": pa.array([g[2] for g in got], pa.int64()),
        "kept": pa.array(keep, pa.bool_()), "text_sha256": pa.array([s.hex() for s in shas], pa.string()), "row_key": pa.array(keys, pa.int64()), "stays": pa.array(stays, pa.bool_()),
    })


def exact_dedup(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256, row_key (a hash of doc_id and text), and stays: kept, and of null ids the one."""
    n = n_parts(docs)
    routes = plan_routes(n * (64 << 20) // BLOCK_BYTES, n)
    source = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    slim = cut(source.mapInArrow(_slim, SLIM))
    blocks = slim.groupBy("block")
    answers = held_by_several(blocks.applyInArrow(_send(routes), MESSAGE), routes)
    suspects = cut(blocks.cogroup(answers.groupBy("sender")).applyInArrow(_suspects(routes), "sha binary, n_local long, n_points long, best_id long, row_key long, block long"))
    wanted = docs.sparkSession.sparkContext.broadcast(KeyFilter(suspects, "row_key"))
    bodies = source.select("row_key", "text").mapInArrow(_bodies(wanted), "row_key long, sha binary, body binary").dropDuplicates(["row_key", "sha"])
    met = suspects.join(bodies, ["row_key", "sha"])
    verified = met.withColumn("bucket", F.pmod(F.xxhash64("sha"), F.lit(n))).groupBy("bucket").applyInArrow(_verify, "block long, sha binary, keep_id long, keep_key long, group_size long")
    return blocks.cogroup(verified.groupBy("block")).applyInArrow(_conclude, "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, row_key long, stays boolean")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the copies: of equal texts the longest row, then the smallest doc_id stays; of rows that repeat both, one."""
    stays = exact_dedup(docs).where("stays")
    return keep_row(docs, stays)
