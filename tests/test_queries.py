"""Every registered query against its DuckDB oracle (sf0.001), plus the
driver entry point."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_mod  # noqa: E402
from oracle_check import compare, duck  # noqa: E402
from veilspark.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert set(df.columns) == {"doc_id", "severity", "output", "log_level"}
    assert df.count() > 0


def test_every_query_has_an_oracle_or_a_reason():
    no_sql = set(QUERIES) - set(SQL)
    assert no_sql == {"eigenvector_centrality"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    info = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert info.get("ok") in (True, None), info
