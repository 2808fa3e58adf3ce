"""Every registered query with SQL gives the rows that DuckDB gives."""

import pytest

from filigree.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(round(r[k], 6)) if isinstance(r[k], float) else repr(r[k]) for k in order) for r in records)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, small, duck, name):
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    df = QUERIES[name](spark, small)
    assert sorted(df.columns) == sorted(columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
