"""Key codecs as column expressions: order-preserving binary keys, text keys, chunk ids and batch payloads."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first byte of a binary key, and the tags of its kinds.
MAGIC = 0xC0
TAGS = {"node": 1, "rack": 2, "disk_group": 3, "disk": 4, "zone": 5, "busy_block": 6, "free_block": 7, "owner_map": 8, "bind_map": 9, "instance": 10, "dg_usage": 11, "recovery_progress": 12}


def big_endian(number: Column, n_bytes: int = 8) -> Column:
    return F.unhex(F.lpad(F.right(F.hex(number.cast("long")), F.lit(2 * n_bytes)), 2 * n_bytes, "0"))


def encode(kind: str, *fields: Column) -> Column:
    """Magic, two bytes of tag, and each field in eight bytes, big end first: byte order is field order."""
    return F.concat(F.unhex(F.lit(f"{MAGIC:02X}{TAGS[kind]:04X}")), *(big_endian(f) for f in fields))


def field(key: Column, nth: int) -> Column:
    return F.conv(F.hex(F.substring(key, 4 + 8 * nth, 8)), 16, -10).cast("long")


def decode_error(key: Column, kind: str, n_fields: int) -> Column:
    """What is wrong with a key of a kind, or null."""
    whole = 3 + 8 * n_fields
    return (
        F.when(F.length(key) < 3, "ShortInput")
        .when(F.hex(F.substring(key, 1, 1)) != f"{MAGIC:02X}", "BadMagic")
        .when(F.hex(F.substring(key, 2, 2)) != f"{TAGS[kind]:04X}", "BadTag")
        .when(F.length(key) < whole, "ShortInput")
        .when(F.length(key) > whole, "TrailingBytes")
    )


def text_path(kind: str, *fields: Column) -> Column:
    """/magic/kind/field/...: numbers as they are, so the order is of text, not of numbers."""
    return F.concat_ws("/", F.lit(""), F.lit("slot"), F.lit(kind), *(f.cast("string") for f in fields))


def id_type(high: Column) -> Column:
    return F.shiftrightunsigned(high, 56)


def id_millis(high: Column) -> Column:
    """The 48 bits of time in an id."""
    return F.shiftrightunsigned(high, 8).bitwiseAND(F.lit((1 << 48) - 1))


def _operations(payload: bytes | None) -> list[tuple[int, bool, bytes, bytes]]:
    """The operations of a batch payload; a malformed rest ends it."""
    out: list[tuple[int, bool, bytes, bytes]] = []
    if payload is None or len(payload) < 2:
        return out
    (count,), at = struct.unpack_from("<H", payload), 2
    for seq in range(count):
        parts = []
        if at + 1 > len(payload) or payload[at] > 1:
            break
        kind, at = payload[at], at + 1
        for _ in range(2):
            if at + 4 > len(payload):
                return out
            (n,), at = struct.unpack_from("<I", payload, at), at + 4
            if at + n > len(payload):
                return out
            parts.append(payload[at : at + n])
            at += n
        out.append((seq, kind == 1, *parts))
    return out


def decode_batches(batches: DataFrame) -> DataFrame:
    """A row for each operation of (slot, payload): u16 count, then kind (0 put, 1 delete), lengths and bytes of key and value, little end first."""
    def decode(parts):
        for part in parts:
            rows = [(s, *op) for s, p in zip(part["slot"], part["payload"], strict=True) for op in _operations(None if p is None else bytes(p))]
            yield pd.DataFrame(rows, columns=["slot", "seq", "is_delete", "key", "value"])

    return batches.select("slot", "payload").mapInPandas(decode, "slot long, seq int, is_delete boolean, key binary, value binary")
