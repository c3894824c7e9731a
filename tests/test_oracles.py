"""Every query with SQL gives the rows that DuckDB gives on the same Parquet files."""

import duckdb
import pytest

from mnemoframe.plans.catalog import ORACLES, QUERIES
from tests.conftest import SMALL

import __spark_entry__  # noqa: F401  (fills the catalogue)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    if hasattr(value, "asDict"):
        return plain(list(value.asDict().values()))
    if isinstance(value, dict):
        return plain(list(value.values()))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, duck):
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    rows = sorted("|".join(plain(row[c]) for c in columns) for row in frame.collect())
    answer = duck.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted("|".join(plain(row[i]) for i in at) for row in answer.fetchall())


def test_each_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
