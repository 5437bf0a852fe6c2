"""Every named query against the SQL that gives its result on another engine."""

import pytest

import __spark_entry__ as entries
from runledger.plans import catalog, checks
from compare import connect, difference
from conftest import SAMPLE


@pytest.fixture(scope="module")
def connection():
    return connect(SAMPLE)


def test_every_query_has_a_check():
    assert set(catalog.queries()) == set(checks.checks())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, connection, name):
    assert difference(entries.queries()[name](spark, SAMPLE), connection, entries.oracle_sql()[name]) is None


def test_the_comparison_sees_a_difference(spark, connection):
    wrong = entries.oracle_sql()["job_status_counts"].replace("count(job_id)", "count(job_id) + 1")
    assert difference(entries.queries()["job_status_counts"](spark, SAMPLE), connection, wrong)


def test_entry(spark):
    assert entries.entry(spark).columns[:2] == ["job_id", "job_name"]
