"""Every registered query against its SQL on whole tables."""

import __spark_entry__ as entry
import pytest
from compare import differences, duck

QUERIES = entry.queries()
CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(small):
    return duck(small)


def test_checks_and_queries_belong_together():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, small, connection, name):
    assert differences(QUERIES[name](spark, small), connection, CHECKS[name]) == []


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 7
    assert [r.bad_review_rate for r in rows] == sorted(
        (r.bad_review_rate for r in rows), reverse=True
    )
