"""Every directory query against its DuckDB SQL on the smallest driver tables."""

import glob
import os

import duckdb
import pytest

from dirlake.plans import catalog, stored  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, FOLDER), duck.sql(catalog.ORACLE_SQL[name])
    assert {n: KINDS[t] for n, t in got.dtypes} == {n: str(t) for n, t in zip(want.columns, want.types, strict=True)}
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
