import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, differences
from workload import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    rows, problems = differences(queries()[name](spark, SF_DIR), con, oracle_sql()[name])
    assert not problems, "\n".join(problems)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r.split for r in rows} <= {"train", "validation", "test"} and sum(r.n for r in rows) == rows[0].total
