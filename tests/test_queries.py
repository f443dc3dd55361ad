"""Every registered query: equal to its SQL, or not empty and with a stable schema."""

import pytest

from pagewright.plans.queries import ORACLE, QUERIES
from tests.oracle import DATA, check


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLE:
        check(df, ORACLE[name])
    else:
        assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(ORACLE) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
