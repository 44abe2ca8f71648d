"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from catalog import QUERIES
from tests.compare import differences, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, connection, name):
    assert differences(spark, SF_DIR, name, connection) == []
