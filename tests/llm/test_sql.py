"""Every query of the subpackage that has SQL gives the same rows in DuckDB."""

import duckdb
import pytest

from tabwright.llm.queries import ORACLES, QUERIES

KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    df = QUERIES[name](spark, small_dir)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert {c[0]: KINDS[str(c[1])] for c in result.description} == dict(df.dtypes)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(result.fetchall())
