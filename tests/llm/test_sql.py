"""Queries that have SQL give its rows."""

import os
import sys

import pytest
from helpers import FOLDER

from logweir.llm.catalog import QUERIES

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import connect, difference  # noqa: E402


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_same_rows(spark, name, folder):
    assert difference(spark, connect(folder), folder, QUERIES[name].job, QUERIES[name].sql) is None
