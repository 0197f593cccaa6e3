"""Every registered query against its SQL on the smallest data; the others must give rows."""

import pytest
from compare import connect, difference

from logweir.plans import all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(n for n, q in all_queries().items() if q.sql))
def test_same_rows(spark, con, name):
    q = all_queries()[name]
    assert difference(spark, con, FOLDER, q.job, q.sql) is None


@pytest.mark.parametrize("name", sorted(n for n, q in all_queries().items() if not q.sql))
def test_gives_rows(spark, name):
    assert all_queries()[name].job(spark, FOLDER).limit(1).count() == 1
