"""Every registered query against its DuckDB twin."""

import pytest

from __spark_entry__ import LLM_QUERIES, entry, oracle_sql, queries
from check_oracles import compare, database


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, sf, db, name):
    ok, note = compare(spark, db, sf, name)
    assert ok, note


def test_registry(spark):
    # principal axes are only fixed up to what SQL cannot iterate; tests/test_vectors.py checks them
    own = {n for n in queries() if n not in LLM_QUERIES}
    assert own - {"pca3"} == set(oracle_sql()) - set(LLM_QUERIES)
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).columns[0] == "qid"
