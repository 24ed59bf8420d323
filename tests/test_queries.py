"""Every log-store query with SQL gives what DuckDB gives."""

import duckdb
import pytest

from tests.conftest import SF
from tidemark import queries

TABLES = ("documents", "events", "orders", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, duck, name):
    got = queries.queries()[name](spark, SF).toPandas()
    want = duck.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    flat = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert flat(got).equals(flat(want))


@pytest.mark.parametrize("name", sorted(queries.queries().keys() - queries.oracle_sql().keys()))
def test_rows_only(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_damage_is_told(spark):
    first, second = queries.corrupt_block_completeness(spark, SF).orderBy("search").collect()
    assert first.partial and first.skipped_blocks == 1 and first.unavailable_blocks == 0
    assert second.partial and second.skipped_blocks == 0 and second.unavailable_blocks == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
