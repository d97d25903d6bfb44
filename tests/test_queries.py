"""Every registered query of the graph engine against its SQL."""

import pytest
from sqlcheck import compare_with_sql

from strandloom import plans

NAMES = sorted(plans.queries())


def test_all_have_sql():
    assert set(plans.oracle_sql()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf_dir, name):
    got, want = compare_with_sql(spark, sf_dir, plans.queries()[name], plans.oracle_sql()[name])
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"tag", "node", "w", "node_first", "end_first"}
    assert set(NAMES) <= set(__spark_entry__.queries())
