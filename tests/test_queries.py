"""Every registered core query runs on the smallest data and agrees with its SQL."""

import importlib

import pytest
from oracle import compare

import __spark_entry__ as entry

MODULES = [importlib.import_module(m) for m in entry.CORE]
NAMES = sorted(n for m in MODULES for n in m.QUERIES)
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, name):
    query = entry.queries()[name]
    if name in SQL:
        compare(spark, data, query, SQL[name])
    else:
        assert len(query(spark, data).collect()) > 0


def test_sql_has_queries():
    assert set(SQL) <= set(NAMES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "score"] and entry.entry(spark).count()
