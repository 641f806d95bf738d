"""Every query that SQL can express, against DuckDB on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table, columns):
    return sorted(zip(*([repr(round(x, 6)) if isinstance(x, float) else repr(x) for x in table[c].to_pylist()] for c in columns), strict=True))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, name):
    got = entry.queries()[name](spark, DATA).toArrow()
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = con.sql(entry.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.schema.names)
    assert columns == sorted(want.schema.names)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
