"""Queries over the driver's tables, by family, and the SQL that must give the same rows."""

from importlib import import_module

FAMILIES = ("kv", "journal", "metrics", "space", "bitmap", "chunk", "fleet", "functions", "stream")
QUERIES: dict = {}
SQL: dict = {}
for _name in FAMILIES:
    _family = import_module(f"slotscope.plans.{_name}")
    QUERIES |= _family.QUERIES
    SQL |= _family.SQL
