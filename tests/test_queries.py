"""Every query of the catalogue against its SQL."""

import os

import pytest

from sparkquiver.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, frame[columns].itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def tables(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, tables, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(tables.execute(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
