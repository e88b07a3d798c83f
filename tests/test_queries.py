"""Every registered query of the library runs; those with SQL give DuckDB's rows."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from dossier import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows_of(df):
    return sorted(str(tuple(None if v != v else int(v) if isinstance(v, float) and v == int(v) else v for v in r)) for r in df[sorted(df)].astype(object).where(df[sorted(df)].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    found = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLE_SQL:
        wanted = db.sql(catalogue.ORACLE_SQL[name]).df()
        assert sorted(found) == sorted(wanted)
        assert rows_of(found) == rows_of(wanted)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
