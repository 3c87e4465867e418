"""Every registered query on the smallest tables, against its SQL twin where it has one."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    _, _, problem = compare(spark, con, name, FOLDER, entry.queries(), entry.oracle_sql())
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
