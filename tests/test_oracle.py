"""Every registered query against its SQL check on the smallest driver tables."""

import os

import pytest

import oracle

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


def test_names_line_up():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_equal_their_sql(spark):
    import __spark_entry__ as entry
    con, sql = oracle.duck(SF_DIR), entry.oracle_sql()
    wrong = {}
    for name, query in entry.queries().items():
        df = query(spark, SF_DIR)
        verdict = oracle.compare(df, con, sql[name]) if name in sql else ("" if df.count() else "no rows")
        if verdict:
            wrong[name] = verdict
    assert wrong == {}
