"""Every query with SQL gives the same rows and types in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck(small_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    yield connection
    connection.close()


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((v is None, type(v).__name__, v if v is not None else 0) for v in row))


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_its_sql(spark, small_dir, duck, name):
    df = entry_points.queries()[name](spark, small_dir)
    result = duck.execute(entry_points.oracle_sql()[name])
    kinds = {c[0]: KINDS[str(c[1])] for c in result.description}
    assert kinds == dict(df.dtypes)
    order = sorted(kinds)
    names = list(kinds)
    expected = [tuple(row[names.index(c)] for c in order) for row in result.fetchall()]
    found = [tuple(row[c] for c in order) for row in df.collect()]
    assert _sorted(found) == _sorted(expected)


def test_entry_gives_rows(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_is_a_function_of_session_and_folder():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
