"""Every query of the catalogue gives its SQL's rows; without SQL it runs and keeps its schema."""

import duckdb
import pytest

from slotscope.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in found.collect()]
    if name in SQL:
        wanted = con.execute(SQL[name])
        columns = [c[0] for c in wanted.description]
        assert sorted(found.columns) == sorted(columns)
        assert normal(found.columns, rows) == normal(columns, wanted.fetchall())
    else:
        assert len(found.columns) == len(set(found.columns))
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
