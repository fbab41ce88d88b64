"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import pytest

from suite import queries as _  # noqa: F401
from suite.check import compare, connect
from suite.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    assert compare(spark, con, sf, name) == ""


def test_only_these_have_no_sql():
    assert set(QUERIES) - set(SQL) == {
        "vector_index_build",
        "hash_embedding",
        "go_symbols",
        "index_sources",
    }
