"""Scalar functions, codecs and placement over the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotscope.functions import erasure, hashing, keys
from slotscope.operators import kv, placement
from slotscope.sources.folders import shared_folder
from slotscope.sources.tables import disk_groups, disks, nodes, table

MIX = ((64, 70), (1024, 20), (16384, 10))


def key_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = keys.encode("busy_block", F.col("l_suppkey"), F.col("l_orderkey"))
    coded = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", key.alias("k")).distinct()
    return coded.select(F.lower(F.hex("k")).alias("key"), keys.field(F.col("k"), 0).alias("zone"), keys.field(F.col("k"), 1).alias("unit_offset"), keys.decode_error(F.col("k"), "busy_block", 2).isNull().alias("ok"))


def key_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    whole = keys.encode("disk", n)
    key = F.when(n % 5 == 1, F.substring(whole, 1, 7)).when(n % 5 == 2, F.concat(F.unhex(F.lit("C1")), F.substring(whole, 2, 10))).when(n % 5 == 3, keys.encode("zone", n)).when(n % 5 == 4, F.concat(whole, F.unhex(F.lit("00")))).otherwise(whole)
    return table(spark, sf_dir, "orders").select(F.coalesce(keys.decode_error(key, "disk", 1), F.lit("ok")).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def text_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in text keys come in order of text: each key with its place."""
    paths = table(spark, sf_dir, "supplier").select(keys.text_path("dg", F.col("s_suppkey")).alias("path"))
    return kv.numbered(paths, "path", shared_folder(spark, "paths"))


def id_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.col("o_orderkey") * 72_057_594_037 + F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", keys.id_type(high).alias("kind"), keys.id_millis(high).alias("millis"))


def xxh64_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.xxh64_bucket(F.col("o_custkey"), F.col("o_orderkey")).alias("bucket"))


def splitmix_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that their keys decide, checked whole; of a third of them one byte is wrong."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    made = o.select("id", hashing.bench_key(F.col("id")).alias("key"), hashing.key_value(F.col("id"), (F.col("id") % 40 + 1)).alias("value"))
    spoilt = made.withColumn("value", F.when(F.col("id") % 3 == 0, F.concat(F.substring("value", 2, 100), F.substring("value", 1, 1))).otherwise(F.col("value")))
    return spoilt.select("id", "key", F.hex("value").alias("value"), hashing.value_is_right(F.col("id"), F.col("value")).alias("ok"))


def size_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(hashing.mixed_size(F.col("o_orderkey"), MIX).alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def batch_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of a put and a delete; every seventh is cut short, and its rest is dropped."""
    le = lambda n, w: F.unhex(F.lit(n.to_bytes(w, "little").hex()))
    key = F.encode(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), "UTF-8")
    whole = F.concat(le(2, 2), le(0, 1), le(8, 4), key, le(3, 4), F.encode(F.lit("abc"), "UTF-8"), le(1, 1), le(8, 4), key, le(0, 4))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slot"), F.when(F.col("o_orderkey") % 7 == 0, F.substring(whole, 1, 25)).otherwise(whole).alias("payload"))
    return keys.decode_batches(rows).select("slot", "seq", "is_delete", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


def crc32_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zone's checksum: over its bitmap's bytes and the eight bytes of its stamp, little end first."""
    stamp = F.reverse(F.split(F.regexp_replace(F.lpad(F.hex("s_suppkey"), 16, "0"), "(..)(?=.)", "$1,"), ","))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.crc32(F.concat(F.encode("s_name", "UTF-8"), F.unhex(F.array_join(stamp, "")))).alias("checksum"))


def crc32c_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32C of repetitions of the usual check text, whose sums are known."""
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.encode(F.repeat(F.lit("123456789"), (o % 3).cast("int")), "UTF-8").alias("body"))
    return rows.select("o_orderkey", hashing.crc32c("body").alias("checksum"))


def value_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whose last byte isn't UTF-8, in hex and as text."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.encode("o_orderpriority", "UTF-8"), F.unhex(F.lit("FF"))).alias("body"))
    in_hex, as_text = hashing.rendered(F.col("body"))
    return o.select("o_orderkey", in_hex.alias("hex"), as_text.alias("text"))


def ec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in 4 + 2 shards, two of them lost, and back."""
    def run(batches):
        for b in batches:
            rows = []
            for i, text in zip(b["doc_id"], b["text"], strict=True):
                data = (text or "").encode()
                shards = erasure.encode(data, 4, 2)
                lost = {int(i) % 6, int(i) * 5 % 6}
                rows.append((i, len(shards[0]), erasure.decode([None if k in lost else s for k, s in enumerate(shards)], 4, 2, len(data)) == data))
            yield pd.DataFrame(rows, columns=["doc_id", "shard_bytes", "ok"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, shard_bytes long, ok boolean")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"))


def mirror_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = disk_groups(spark, sf_dir).join(nodes(spark, sf_dir), "node_id")
    return placement.mirror(_customers(spark, sf_dir), groups, 3)


def ec_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.erasure_coded(_customers(spark, sf_dir), disk_groups(spark, sf_dir), 6, 2)


def ec_placement_few_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four nodes, which take two blocks each where they have two groups."""
    return placement.erasure_coded(_customers(spark, sf_dir), disk_groups(spark, sf_dir).withColumn("node_id", F.col("node_id") % 4), 6, 2)


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Lines dealt out by supplier in parts that hold as many whatever the input, and their number; what is grouped by supplier and more stays in its part."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    n = line.count()
    return line.repartition(1 + n // placement.ROWS_A_TASK, "l_suppkey"), n


def zone_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, n = _lines(spark, sf_dir)
    requests = line.groupBy(F.col("l_suppkey").alias("zone_id"), F.col("l_orderkey").alias("at")).agg(F.sum("l_linenumber").cast("long").alias("units"))
    return placement.allocate(requests, 2048, n)


def zone_allocate_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each zone: its requests, those whose units overlap others or leave the zone (none), and whether its units fit."""
    found = zone_allocate(spark, sf_dir).withColumn("placed", F.col("unit_offset") >= 0)
    before = F.max(F.col("unit_offset") + F.col("units")).over(W.partitionBy("zone_id", "placed").orderBy("unit_offset").rowsBetween(W.unboundedPreceding, -1))
    marked = found.withColumn("bad", F.col("placed") & ((F.col("unit_offset") < F.coalesce(before, F.lit(0))) | (F.col("unit_offset") + F.col("units") > 2048)))
    used = F.coalesce(F.sum(F.when(F.col("placed"), F.col("units"))), F.lit(0))
    return marked.groupBy("zone_id").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), (used <= 2048).alias("fits"))


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    line, n = _lines(spark, sf_dir)
    requests = line.groupBy(F.col("l_suppkey").alias("dg_id"), F.col("l_orderkey").alias("at")).agg(F.sum("l_linenumber").cast("long").alias("units"), (F.min("l_linenumber") % 3 + 1).cast("long").alias("n"))
    return requests, disks(spark, sf_dir).where("disk_status = 1").select("dg_id", "disk_no"), n


def dg_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, up, n = _blocks(spark, sf_dir)
    return placement.allocate_blocks(requests, up, zones_each=2, capacity=512, about=n)


def dg_allocate_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group: its requests, and blocks that share a disk with one of their request, overlap, or stand beyond their zone (none of them).

    The allocation is run once and its rows are dealt out by group once; all that is counted stays within a group's part.
    """
    n = table(spark, sf_dir, "lineitem").count()
    found = dg_allocate(spark, sf_dir).repartition(1 + n // placement.ROWS_A_TASK, "dg_id")
    before = F.max(F.col("unit_offset") + F.col("units")).over(W.partitionBy("dg_id", "disk_no", "zone").orderBy("unit_offset").rowsBetween(W.unboundedPreceding, -1))
    bad = (F.col("nth") >= 0) & ((F.col("unit_offset") < F.coalesce(before, F.lit(0))) | (F.col("unit_offset") + F.col("units") > 512))
    on_disk = found.withColumn("bad", bad).groupBy("dg_id", "at", "disk_no").agg((F.count_if(F.col("nth") >= 0)).alias("placed"), F.count_if("bad").alias("n_bad"))
    of_request = on_disk.groupBy("dg_id", "at").agg(F.sum(F.greatest(F.col("placed") - 1, F.lit(0))).alias("n_shared"), F.sum("n_bad").alias("n_bad"))
    return of_request.groupBy("dg_id").agg(F.count("*").alias("n"), F.sum("n_shared").alias("n_shared"), F.sum("n_bad").alias("n_bad"))


QUERIES = {f.__name__: f for f in (key_codec_roundtrip, key_errors, text_key_order, id_fields, xxh64_bucket, splitmix_value, size_mix, batch_decode, crc32_zone, crc32c_known, value_render, ec_roundtrip, mirror_placement, ec_placement, ec_placement_few_nodes, zone_allocate, zone_allocate_checked, dg_allocate, dg_allocate_checked)}

_DRAW = "((request % 1000003) * 1103515245 + {salt} * 12345) % 2147483647 % {n}"
_MIRROR = f"""WITH n AS (SELECT n_regionkey::BIGINT AS rack_id, n_nationkey::BIGINT AS node_id, list(s_suppkey ORDER BY s_suppkey) AS dgs FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
r AS (SELECT rack_id, list({{'node_id': node_id, 'dgs': dgs}} ORDER BY node_id) AS nodes FROM n GROUP BY 1),
t AS (SELECT list({{'rack_id': rack_id, 'nodes': nodes}} ORDER BY rack_id) AS racks, count(*) AS n FROM r),
s AS (SELECT list(x ORDER BY x) AS strides FROM range(1, 1000) q(x), t WHERE x <= n AND gcd(x, n) = 1),
c AS (SELECT c_custkey AS request, unnest(range(0, CASE WHEN n >= 3 THEN 3 ELSE 3 * n END)) AS i, n, racks, strides FROM customer, t, s),
k AS (SELECT request, i, i // n AS turn, racks[({_DRAW.format(salt=1, n='n')} + i * strides[{_DRAW.format(salt=2, n='len(strides)')} + 1]) % n + 1] AS rack FROM c),
m AS (SELECT request, i, turn, rack, rack.nodes[({_DRAW.format(salt=3, n='len(rack.nodes)')} + turn) % len(rack.nodes) + 1] AS node FROM k WHERE turn < len(rack.nodes))
SELECT request, nth, rack_id, node_id, dg_id FROM (SELECT request, row_number() OVER (PARTITION BY request ORDER BY i)::INTEGER AS nth, rack.rack_id AS rack_id, node.node_id AS node_id, node.dgs[{_DRAW.format(salt=4, n='len(node.dgs)')} + 1] AS dg_id FROM m) WHERE nth <= 3"""


def _coded(node: str) -> str:
    return f"""WITH n AS (SELECT ({node})::BIGINT AS node_id, list(s_suppkey ORDER BY s_suppkey) AS dgs FROM supplier GROUP BY 1),
t AS (SELECT list({{'node_id': node_id, 'dgs': dgs}} ORDER BY node_id) AS nodes, count(*) AS n FROM n),
c AS (SELECT c_custkey AS request, n, unnest(range(0, CASE WHEN n >= 8 THEN 8 ELSE 2 * n END)) AS i, nodes FROM customer, t),
m AS (SELECT request, i, i // n AS turn, nodes[(request + i) % n + 1] AS node FROM c),
p AS (SELECT request, row_number() OVER (PARTITION BY request ORDER BY i) - 1 AS block, node.node_id AS node_id, node.dgs[(turn + request) % len(node.dgs) + 1] AS dg_id FROM m WHERE turn < len(node.dgs)),
f AS (SELECT *, count(*) OVER (PARTITION BY request) AS found FROM p)
SELECT request, block::INTEGER AS block, node_id, dg_id FROM f WHERE found >= 8 AND block < 8 UNION ALL SELECT c_custkey, -1, -1, -1 FROM customer WHERE c_custkey NOT IN (SELECT request FROM f WHERE found >= 8)"""


SQL = {
    "mirror_placement": _MIRROR,
    "ec_placement": _coded("s_nationkey"),
    "ec_placement_few_nodes": _coded("s_nationkey % 4"),
    "ec_roundtrip": "SELECT doc_id, greatest(1, (strlen(coalesce(text, '')) + 3) // 4)::BIGINT AS shard_bytes, true AS ok FROM documents",
    "crc32c_known": f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN {hashing.crc32c_of([b'123456789'])[0]} ELSE {hashing.crc32c_of([b'123456789' * 2])[0]} END AS checksum FROM orders",
    "value_render": "SELECT o_orderkey, lower(hex(encode(o_orderpriority))) || 'ff' AS hex, o_orderpriority || chr(65533) AS text FROM orders",
    "zone_allocate_checked": "SELECT l_suppkey AS zone_id, count(DISTINCT l_orderkey) AS n, 0::BIGINT AS n_bad, true AS fits FROM lineitem GROUP BY 1",
    "dg_allocate_checked": "SELECT l_suppkey AS dg_id, count(DISTINCT l_orderkey) AS n, 0::BIGINT AS n_shared, 0::BIGINT AS n_bad FROM lineitem GROUP BY 1",
    "key_codec_roundtrip": "SELECT DISTINCT 'c00006' || lpad(lower(to_hex(l_suppkey)), 16, '0') || lpad(lower(to_hex(l_orderkey)), 16, '0') AS key, l_suppkey AS zone, l_orderkey AS unit_offset, true AS ok FROM lineitem",
    "key_errors": "SELECT CASE o_orderkey % 5 WHEN 1 THEN 'ShortInput' WHEN 2 THEN 'BadMagic' WHEN 3 THEN 'BadTag' WHEN 4 THEN 'TrailingBytes' ELSE 'ok' END AS error, count(*) AS n FROM orders GROUP BY 1",
    "text_key_order": "SELECT path, row_number() OVER (ORDER BY path) - 1 AS place FROM (SELECT '/slot/dg/' || s_suppkey AS path FROM supplier)",
    "id_fields": "SELECT o_orderkey, (o_orderkey * 72057594037 + o_custkey) >> 56 AS kind, ((o_orderkey * 72057594037 + o_custkey) >> 8) & 281474976710655 AS millis FROM orders",
    "size_mix": "SELECT CASE WHEN o_orderkey % 100 < 70 THEN 64 WHEN o_orderkey % 100 < 90 THEN 1024 ELSE 16384 END AS size, count(*) AS n FROM orders GROUP BY 1",
    "batch_decode": "SELECT o_orderkey AS slot, seq, seq = 1 AS is_delete, lpad(o_orderkey::VARCHAR, 8, '0') AS key, CASE seq WHEN 0 THEN 'abc' ELSE '' END AS value FROM orders, (VALUES (0), (1)) s(seq) WHERE seq = 0 OR o_orderkey % 7 <> 0",
}
