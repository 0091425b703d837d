"""Every registered query against its DuckDB oracle on the smallest data
(the driver runs the same comparison at sf0.01)."""

import os
import sys

import duckdb
import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "scripts"))
import __spark_entry__ as E  # noqa: E402
from oracle_check import compare  # noqa: E402
from quizlens.sources.tables import TABLES, table_path  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{table_path(SF_SMALL, t)}')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    res = compare(name, E.queries()[name](spark, SF_SMALL), con, E.oracle_sql()[name])
    assert res.startswith("ok") and "TYPES" not in res, res


def test_every_query_has_an_oracle_or_is_listed():
    rows_only = set(E.queries()) - set(E.oracle_sql()) - set(E.LLM_QUERIES)
    assert rows_only <= {"generate_stub"}, rows_only


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "acc" in df.columns
