"""Every registered query of the engine against its SQL."""

import pytest

from lodeworks.plans import catalogue

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    cols, got = oracle.spark_rows(catalogue.QUERIES[name](spark, SF))
    want_cols, want = oracle.sql_rows(SF, catalogue.ORACLE_SQL[name])
    assert cols == want_cols
    assert len(got) == len(want) and got == want and len(got) > 0
