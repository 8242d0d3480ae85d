"""Every query against its SQL on whole small tables."""

import pytest
from conftest import plain

from larkspan.plans import catalogue


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, data, duck, name):
    got = catalogue.QUERIES[name](spark, data).toPandas()
    if name not in catalogue.SQL:
        assert len(got)
        return
    want = duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got).equals(plain(want))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
