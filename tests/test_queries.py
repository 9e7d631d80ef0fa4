"""Every registered query of the library against its SQL, over whole tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from evidra import catalog


def same(spark_rows, sql_rows):
    assert sorted(spark_rows.columns) == sorted(sql_rows.columns)
    columns = sorted(spark_rows.columns)

    def shown(v):
        if pd.isna(v):
            return "null"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    a, b = (sorted(tuple(map(shown, r)) for r in x[columns].astype(object).values.tolist()) for x in (spark_rows, sql_rows))
    assert a == b


@pytest.fixture(scope="session")
def sql(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, sql, name):
    same(catalog.QUERIES[name](spark, sf).toPandas(), sql.execute(catalog.ORACLE_SQL[name]).df())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
