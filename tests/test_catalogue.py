"""Every query with an SQL form gives the rows that DuckDB gives."""

import duckdb
import pytest

from cairn.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(tuple(str(v) for v in r) for r in plain.itertuples(index=False)), columns


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, small, duck, name):
    ours, theirs = catalogue.queries()[name](spark, small).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, small, name):
    assert catalogue.queries()[name](spark, small).count() > 0
