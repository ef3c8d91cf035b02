"""The driver contract: SQL oracles on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SKIP = ("op", "pipeline")


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "class", "n"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(SKIP)])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "part", "pages", "conversations", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    own = entry.queries()[name](spark, SF).toPandas()
    other = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(own.columns)
    assert columns == sorted(other.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values))
    assert rows(own) == rows(other)
