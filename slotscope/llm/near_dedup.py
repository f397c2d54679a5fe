"""MinHash near-deduplication by an LSH forest.

Documents with equal shingle sets are one node. A node has a MinHash signature; each tree of the forest is one sorted
order of the nodes by its own stretch of the signature. A node's candidates are its nearest neighbours in each
order, those with the longest common prefixes: in a thin region that reaches up to shallow tree nodes, in a dense one
it stays with the deepest, so depth adapts to the region. Of them the most alike by sketch count. The forest is walked twice: first the
most alike neighbour on each side ties the nodes of a dense region together; then the nodes that have neighbours are ordered again, and look for
the most alike among those of other components alone, which what is linked already can't crowd out. Orders are range-partitioned with the
node in the key, so ever so many equal signatures split; the rows on both sides of a border are compared in a task of their own, so
where borders fall decides nothing. A sketch of one bit a MinHash, on the second walk of four, drops unlike
candidates. Those of the first walk are confirmed on their full shingle sets, pair by pair.

Where a region holds more nodes than an order reaches, or more alike ones than become candidates, links may be left. So
components that candidates of either walk tie together are a cluster, and all pairs of a cluster that lie between different components are
compared exactly, on full shingle sets: nodes outside the cluster's largest component meet all others, block by block. A dense region's many
candidates of the second walk so need no confirming of their own. Where each pair of a cluster was a candidate, these are confirmed instead.

Defined results: null and empty texts, and texts without words, have no shingles and link with nothing; a text of
fewer words than a shingle has is one shingle; rows that repeat share a component; a null doc_id never is a component's
smallest, unless all are null; no rows give no rows; other columns are not read. keep_one leaves one row of each component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotscope.llm.components import components
from slotscope.llm.shared import KeyFilter, keep_row, n_parts, stash, utf8_column
from slotscope.llm.words import mix, stream, words_of

TREES, DEPTH = 24, 6
HASHES = TREES * DEPTH
#: Neighbours on each side in each order whose sketches are compared, and of them the most alike of other components that become candidates.
REACH, MOST_ALIKE = 128, 4
#: Bits of each MinHash in the sketches of the first walk, over all nodes, and of the second, over those with neighbours.
BITS, MORE_BITS = 1, 4
#: Nodes of a block of a cluster, on average, and shingles that are compared at once.
BLOCK, STRIP = 256, 4096

_MULTIPLY = (stream(HASHES, 101) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (stream(HASHES, 102) >> np.uint64(32)).astype(np.uint32)
_PLACE = stream(64, 103) | np.uint64(1)


def shingle_sets(column, n_words: int):
    """The distinct shingles of each row's text, as sorted 64-bit hashes."""
    for _, n, hashes, ends in words_of(column):
        whole = np.zeros(max(0, len(hashes) - n_words + 1), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n_words):
                whole += hashes[j : j + len(whole)] * _PLACE[j]
            whole = mix(whole)
            for k in range(n):
                i, j = ends[k], ends[k + 1]
                if j - i >= n_words:
                    yield np.unique(whole[i : j - n_words + 1])
                elif j > i:
                    yield mix((hashes[i:j] * _PLACE[: j - i]).sum(keepdims=True) + np.uint64(j - i))
                else:
                    yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash over the shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[at : at + 1024, None] * _MULTIPLY + _ADD).min(0), out=least)
    return least


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        return np.array([mix(shingles ^ np.uint64(1)).sum(), mix(shingles ^ np.uint64(2)).sum()], np.uint64).tobytes()


def _sign(n_words: int):
    def sign(batches):
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for s in shingle_sets(batch.column("text"), n_words):
                sizes.append(len(s))
                digests.append(digest(s) if len(s) else None)
                signatures.append(signature(s).astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "row_key", "n_shingles", "node", "signature"])

    return sign


def _sketch(signatures: np.ndarray, bits: int) -> np.ndarray:
    """The last one or four bits of each MinHash, in 64-bit words."""
    last = (signatures & ((1 << bits) - 1)).astype(np.uint8)
    packed = np.packbits(last, axis=1) if bits == 1 else last[:, ::2] | last[:, 1::2] << 4
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))


def _unlike(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """How many MinHashes differ between rows of sketches."""
    differ = x ^ y
    if bits == 4:  # a group of four bits differs where any does
        differ |= differ >> np.uint64(1)
        differ |= differ >> np.uint64(2)
        differ &= np.uint64(0x1111111111111111)
    return np.bitwise_count(differ).sum(1, dtype=np.int16)


def _orders(bits: int):
    """A row for each node and tree: the tree's stretch of the signature, the size, the sketch and the node's component."""

    def orders(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, _ = utf8_column(batch.column("signature"))
            whole = data.reshape(-1, HASHES * 4)
            sketch = _sketch(whole.view(">u4"), bits)
            n = len(whole)
            for t in range(TREES):
                prefix = np.ascontiguousarray(whole[:, t * DEPTH * 4 : (t + 1) * DEPTH * 4])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, t, np.int32)), pa.array([x.tobytes() for x in prefix], pa.binary()), batch.column("node"), batch.column("n_shingles"), pa.array([x.tobytes() for x in sketch], pa.binary()), batch.column("root")],
                    ["tree", "prefix", "node", "n_shingles", "sketch", "root"],
                )

    return orders


def least_agreement(similarity: float, bits: int) -> int:
    """MinHashes of equal last bits that a pair of this similarity falls short of by chance with five standard deviations."""
    p = similarity + (1 - similarity) / (1 << bits)
    return math.floor(HASHES * p - 5 * math.sqrt(HASHES * p * (1 - p)))


def _best_pairs(rows: pa.Table, ahead: np.ndarray, behind: np.ndarray, percent: int, most: int, bits: int) -> dict:
    """For the rows marked in ahead (behind), pairs with the most alike of the REACH rows that follow (precede) them.

    A pair shares a tree and a first MinHash but no component, and its sizes and sketches allow the similarity. A null root is a component of its own.
    """
    n, enough = rows.num_rows, least_agreement(percent / 100, bits)
    trees, sizes = rows.column("tree").to_numpy(), rows.column("n_shingles").to_numpy()
    prefix = utf8_column(rows.column("prefix"))[0].reshape(-1, DEPTH * 4).view(">u4")
    roots = rows.column("root").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    sketch = np.ascontiguousarray(utf8_column(rows.column("sketch"))[0].reshape(n, -1)).view(np.uint64)
    agree = np.full((n, REACH), -1, np.int16)  # of each row with the k-th after it
    before = np.full((n, REACH), -1, np.int16)  # and with the k-th before it
    for k in range(1, min(REACH, n - 1) + 1):
        i, j = slice(0, n - k), slice(k, n)
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        same = HASHES - _unlike(sketch[i], sketch[j], bits)
        ok = (trees[i] == trees[j]) & (prefix[i, 0] == prefix[j, 0]) & (100 * small >= percent * large) & (same >= enough) & ((roots[i] != roots[j]) | (roots[i] < 0))
        agree[i, k - 1] = before[j, k - 1] = np.where(ok, same, -1)
    found = []
    for mine, side, sign in ((np.flatnonzero(ahead), agree, 1), (np.flatnonzero(behind), before, -1)):
        side, every = side[mine], np.arange(len(mine))
        for _ in range(most):
            k = side.argmax(1)
            i = np.flatnonzero(side[every, k] >= 0)
            found.append(np.stack([mine[i], mine[i] + sign * (k[i] + 1)], 1))
            side[every, k] = -1
    pair = np.sort(np.concatenate(found), 1)
    pair = np.unique(pair[:, 0] * n + pair[:, 1])
    u, v = pair // n, pair % n
    nodes = pa.concat_arrays(rows.column("node").chunks)
    of = pa.concat_arrays(rows.column("root").chunks)
    return {"x": nodes.take(pa.array(u)), "y": nodes.take(pa.array(v)), "root_x": of.take(pa.array(u)), "root_y": of.take(pa.array(v))}


PAIRS = "x binary, y binary, root_x binary, root_y binary"
#: The rows that stand next to a border of partitions, in order by seq, which is below 0 before the border.
EDGES = "border long, seq int, tree int, prefix binary, node binary, n_shingles long, sketch binary, root binary"


def _neighbours(percent: int, most: int, bits: int):
    """Pairs of near rows of one order. What lies beyond the partition's borders isn't looked at, and so the first rows don't look back nor the last ones ahead."""

    def neighbours(batches):
        held, done, passed = None, 0, 0  # of the rows held, those that have their pairs; and rows let go before them

        def pairs(rows: pa.Table, upto: int, ahead: bool) -> pa.RecordBatch:
            place = np.arange(rows.num_rows)
            mine = (place >= done) & (place < upto)
            return pa.RecordBatch.from_pydict(_best_pairs(rows, mine & ahead, mine & (place + passed >= REACH), percent, most, bits))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows - REACH > done:
                held = held.combine_chunks()
                ready = held.num_rows - REACH
                yield pairs(held, ready, True)
                gone = max(0, ready - REACH)
                held, done, passed = held.slice(gone), ready - gone, passed + gone
        if held is not None:
            yield pairs(held.combine_chunks(), held.num_rows, False)

    return neighbours


def _edges(batches):
    """The first and the last REACH rows of a partition, each for the border that it stands next to."""
    here, head, tail = TaskContext.get().partitionId(), None, None

    def edge(rows: pa.Table, border: int, since: int) -> pa.RecordBatch:
        n = rows.num_rows
        given = {"border": pa.array([border] * n, pa.int64()), "seq": pa.array(range(since, since + n), pa.int32())}
        return pa.RecordBatch.from_pydict(given | {c: pa.concat_arrays(rows.column(c).chunks) for c in ("tree", "prefix", "node", "n_shingles", "sketch", "root")})

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if head is None or head.num_rows < REACH:
            head = (rows if head is None else pa.concat_tables([head, rows])).slice(0, REACH)
        tail = rows if tail is None else pa.concat_tables([tail, rows])
        tail = tail.slice(max(0, tail.num_rows - REACH))
    if head is not None and head.num_rows:
        yield edge(head, here, 0)
        yield edge(tail, here + 1, -tail.num_rows)


def _over_border(percent: int, most: int, bits: int):
    def over(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq").combine_chunks()
        before = rows.column("seq").to_numpy() < 0
        return pa.table(_best_pairs(rows, before, ~before, percent, most, bits))

    return over


def _candidates(nodes: DataFrame, percent: int, most: int, bits: int, parts: int) -> DataFrame:
    """Pairs (u, v) of near nodes that share no root, with root_u and root_v."""
    # partitions are large beside a node's neighbours
    parts = max(1, min(max(parts, TREES), nodes.count() * TREES // (40 * REACH)))
    orders = nodes.select("node", "n_shingles", "signature", "root").mapInArrow(_orders(bits), "tree int, prefix binary, node binary, n_shingles long, sketch binary, root binary")
    sorted_orders = orders.repartitionByRange(parts, "tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")
    # both read one exchange of the sorted orders
    over = sorted_orders.mapInArrow(_edges, EDGES).groupBy("border").applyInArrow(_over_border(percent, most, bits), PAIRS)
    near = sorted_orders.mapInArrow(_neighbours(percent, most, bits), PAIRS).unionByName(over)
    x, y = F.struct(F.col("x").alias("node"), F.col("root_x").alias("root")), F.struct(F.col("y").alias("node"), F.col("root_y").alias("root"))
    return near.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.root").alias("root_u"), F.col("b.root").alias("root_v")).distinct()


def _squeeze(wanted):
    """The texts of the rows that the filter lets through, compressed."""

    def squeeze(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            batch = batch.filter(pa.array(wanted.value.has(batch.column("row_key").to_numpy())))
            data, offsets = utf8_column(batch.column("text"))
            view = memoryview(np.ascontiguousarray(data))
            bodies = [press.compress(view[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), pa.array(bodies, pa.binary())], ["row_key", "text_id", "body"])

    return squeeze


def _confirm(n_words: int, percent: int):
    """Pairs whose full shingle sets are similar enough."""

    def confirm(batches):
        open_up = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [list(shingle_sets(pa.array([open_up.decompress(x) for x in part.column(c).to_pylist()], pa.large_binary()), n_words)) for c in ("body_u", "body_v")]
                keep = []
                for a, b in zip(*sets, strict=True):
                    union = len(np.union1d(a, b))
                    keep.append(100 * (len(a) + len(b) - union) >= percent * union)
                linked = part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
                yield linked

    return confirm


def common_shingles(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of a shares with each of b."""
    flat = [np.concatenate(x) for x in (a, b)]
    both = np.intersect1d(*flat)
    sides = []
    for sets, values in zip((a, b), flat, strict=True):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(both, values), max(0, len(both) - 1))
        held = both[at] == values if len(both) else np.zeros(len(values), bool)
        order = np.argsort(at[held], kind="stable")
        sides.append((row[held][order], at[held][order], len(sets)))
    shared = np.zeros((len(a), len(b)), np.int64)
    for begin in range(0, len(both), STRIP):
        strips = []
        for row, at, n in sides:
            i, j = np.searchsorted(at, (begin, begin + STRIP))
            strip = np.zeros((n, STRIP), np.float32)  # sums of at most STRIP ones are exact
            strip[row[i:j], at[i:j] - begin] = 1
            strips.append(strip)
        shared += (strips[0] @ strips[1].T).astype(np.int64)
    return shared


def _compare(n_words: int, percent: int):
    """All pairs of a block of nodes outside a cluster's largest component with a block of its nodes, by their full shingle sets."""

    def compare(rows: pa.Table) -> pa.Table:
        open_up = zstandard.ZstdDecompressor()
        outside = rows.column("outside").to_numpy()
        sides = [rows.filter(pa.array(outside)), rows.filter(pa.array(~outside))]
        u, v = (x.column("node").to_pylist() for x in sides)
        if not u or not v:
            return pa.table({"u": pa.array([], pa.binary()), "v": pa.array([], pa.binary())})
        sets = [list(shingle_sets(pa.array([open_up.decompress(x) for x in side.column("body").to_pylist()], pa.large_binary()), n_words)) for side in sides]
        root_u, root_v = (np.array(x.column("root").to_pylist(), object) for x in sides)
        size_u, size_v = (np.array([len(x) for x in side], np.int64) for side in sets)
        shared = common_shingles(*sets)
        linked = (100 * shared >= percent * (size_u[:, None] + size_v[None, :] - shared)) & (root_u[:, None] != root_v[None, :])
        i, j = np.nonzero(linked)
        return pa.table({"u": pa.array([min(u[a], v[b]) for a, b in zip(i, j, strict=True)], pa.binary()), "v": pa.array([max(u[a], v[b]) for a, b in zip(i, j, strict=True)], pa.binary())})

    return compare


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components of roots with links (u, v) between them."""
    return components(roots.toDF("u", "v").unionByName(links)) if links.head(1) else roots


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs that lie between different components, with their roots."""
    rooted = pairs.join(roots.toDF("u", "root_u"), "u", "left").join(roots.toDF("v", "root_v"), "v", "left")
    return rooted.withColumns({"root_u": F.coalesce("root_u", "u"), "root_v": F.coalesce("root_v", "v")}).where("root_u != root_v")


def _left_over(nodes: DataFrame, pairs: DataFrame, more: DataFrame, bodies: DataFrame, roots: DataFrame, n_words: int, percent: int, confirmed) -> DataFrame:
    """Links (u, v) between components that candidates tie together, among all their nodes. pairs are confirmed, and so no links where they lie apart; more are not."""
    tried, fresh = _apart(pairs.select("u", "v"), roots).withColumn("fresh", F.lit(False)), more.withColumn("fresh", F.lit(True))
    apart = stash(tried.unionByName(fresh).groupBy("u", "v", "root_u", "root_v").agg(F.bool_and("fresh").alias("fresh")), "apart")
    tied = components(apart.select(F.col("root_u").alias("u"), F.col("root_v").alias("v")))
    clusters = stash(tied.toDF("root", "cluster").unionByName(tied.select(F.col("root").alias("cluster")).distinct().select(F.col("cluster").alias("root"), "cluster")), "clusters")
    held = stash(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")).join(clusters, "root"), "held")
    tried = apart.groupBy("root_u").agg(F.count("*").alias("n")).join(clusters.toDF("root_u", "cluster"), "root_u").groupBy("cluster").agg(F.sum("n").alias("tried"))
    counts = held.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster")
    plan = counts.agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within")).join(tried, "cluster")
    plan = stash(plan.where("n * n - within > 2 * tried").select("cluster", F.col("top.root").alias("top"), F.expr(f"(n - top.n + {BLOCK - 1}) div {BLOCK}").alias("parts"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("others")), "plan")
    placed = stash(held.join(plan, "cluster").join(bodies, "node"), "placed")
    dealt = lambda c: F.pmod(F.xxhash64("node"), c)
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    outside = placed.where("root != top").select("cluster", dealt("parts").alias("part"), every("others").alias("other"), F.lit(True).alias("outside"), "node", "root", "body")
    others = placed.select("cluster", every("parts").alias("part"), dealt("others").alias("other"), F.lit(False).alias("outside"), "node", "root", "body")
    met = outside.unionByName(others).groupBy("cluster", "part", "other").applyInArrow(_compare(n_words, percent), "u binary, v binary")
    small = clusters.join(plan, "cluster", "left_anti").select(F.col("root").alias("root_u"))
    rest = stash(apart.where("fresh").join(small, "root_u", "left_semi").select("u", "v"), "rest")
    return stash(met.unionByName(confirmed(rest)).distinct(), "links")


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """A row for each document: doc_id, row_key (a hash of doc_id and text), n_shingles, component_id, kept, and stays: kept, and of rows of one id the one."""
    n = n_parts(docs)
    source = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    signed = stash(source.mapInArrow(_sign(n_words), "doc_id long, row_key long, n_shingles long, node binary, signature binary"), "signed")
    best_row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    nodes = stash(signed.where("node IS NOT NULL").groupBy("node", "n_shingles", "signature").agg(F.min(best_row).alias("best")), "nodes")

    pairs = stash(_candidates(nodes.withColumn("root", F.lit(None).cast("binary")), percent, 1, BITS, n), "pairs")

    met = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = stash(nodes.select("node", F.col("best.row_key").alias("row_key"), F.col("best.doc_id").alias("row_id")).join(met, "node"), "wanted")
    some = docs.sparkSession.sparkContext.broadcast(KeyFilter(wanted, "row_key"))
    texts = source.mapInArrow(_squeeze(some), "row_key long, text_id long, body binary")
    bodies = texts.join(wanted, "row_key").where(F.col("text_id").eqNullSafe(F.col("row_id"))).dropDuplicates(["node"]).select("node", "body")
    bodies = stash(bodies, "bodies")

    def confirmed(some: DataFrame) -> DataFrame:
        with_u = some.join(bodies.select(F.col("node").alias("u"), F.col("body").alias("body_u")), "u")
        with_both = with_u.join(bodies.select(F.col("node").alias("v"), F.col("body").alias("body_v")), "v")
        return stash(with_both.select("u", "v", "body_u", "body_v").mapInArrow(_confirm(n_words, percent), "u binary, v binary"), "links")

    roots = components(confirmed(pairs))

    # a node without a neighbour before has none among those of other components
    again = nodes.join(wanted.select("node"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = stash(_candidates(again, percent, MOST_ALIKE, MORE_BITS, n), "pairs")
    roots = _joined(roots, _left_over(nodes, pairs, more, bodies, roots, n_words, percent, confirmed))

    rooted = nodes.select("node", "best").join(roots, "node", "left").select("node", "best", F.coalesce("root", "node").alias("root"))
    # a large component is a hot key: written first, its row meets its nodes in a join whose sides Spark can split or broadcast
    least = stash(rooted.groupBy("root").agg(F.min("best").alias("least")), "components")
    named = rooted.join(least, "root").select("node", "least")
    found = signed.select("doc_id", "row_key", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    kept = component.eqNullSafe(F.col("doc_id"))
    return found.select("doc_id", "row_key", "n_shingles", component.alias("component_id"), kept.alias("kept"), (F.col("node").isNull() | (kept & (F.col("row_key") == F.col("least.row_key")))).alias("stays"))


def keep_one(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one of the smallest id; of rows that repeat both id and text, one."""
    return keep_row(docs, near_duplicates(docs, n_words, percent).where("stays"))
