"""Every query of the library against its SQL over the smallest tables."""

import duckdb
import pytest

from sourceloom import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    show = lambda v: str(round(v, 6) if isinstance(v, float) else v)
    return sorted([tuple(show(row[c]) for c in columns) for row in rows])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df, expected = queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(expected.columns) == columns
    assert {c: KINDS[k] for c, k in df.dtypes} == dict(zip(expected.columns, map(str, expected.types)))
    at = {c: k for k, c in enumerate(expected.columns)}
    assert rows_of(columns, df.collect()) == rows_of([at[c] for c in columns], expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_run(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
