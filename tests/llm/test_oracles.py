"""Registered queries against their SQL, and the guard around the subpackage."""

import pytest

from tracesift.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_equals_sql(name, compare):
    compare(QUERIES[name], ORACLES[name])


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
