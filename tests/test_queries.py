"""Registered queries against their SQL, and stable schemas."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from larkdoc.plans import queries as plans


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    if hasattr(value, "to_pydatetime"):
        value = value.to_pydatetime()
    return None if value is None or value != value else value


def rows(frame):
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    want = con.execute(plans.oracle_sql()[name]).df()
    got = plans.queries()[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert plans.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    assert entry.entry(spark).columns == ["qid", "chunk_id", "overlap", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
