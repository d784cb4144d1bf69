"""Every registered query against its SQL."""

import pytest

from tracesift.queries import ALL


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_equals_sql(name, compare):
    run, sql = ALL[name]
    compare(run, sql)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
