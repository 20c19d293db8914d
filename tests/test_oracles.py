"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry_module
from check_oracles import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query(spark, connection, name):
    state, detail, _, _ = compare(spark, connection, SF, name)
    assert state in ("ok", "rows"), detail


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
