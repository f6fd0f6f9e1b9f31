"""Every registered query against its SQL, or, without SQL, for rows and repeatability."""

import pytest

from lumenframe.plans import catalogue
from tests.compare import difference, rows, views


@pytest.fixture(scope="module")
def con(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLE:
        assert difference(df, con, catalogue.ORACLE[name]) == ""
    else:
        first = rows(df.columns, [tuple(r) for r in df.collect()])
        again = catalogue.QUERIES[name](spark, sf_dir)
        assert first and first == rows(again.columns, [tuple(r) for r in again.collect()])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
