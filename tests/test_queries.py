"""Every registered query over the small tables, against its SQL where it has one."""

import pytest
from oracle import both

from corvina.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    if name in ORACLE:
        ours, theirs = both(spark, QUERIES[name], ORACLE[name], SF)
        assert ours == theirs
    else:
        assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
