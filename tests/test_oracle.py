"""Every SQL-expressible query against DuckDB on the same files."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import connect, differences


@pytest.fixture(scope="module")
def sf_dir():
    """The smallest size at which the default thresholds leave rows in every result."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, sf_dir, con, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert differences(got, con.execute(entry.oracle_sql()[name]).df()) == ""
    assert len(got) > 0


def test_entry_is_not_empty(spark):
    row = entry.entry(spark).first()
    assert row["n_users"] > 0 and 0 <= row["mean_auc"] <= 1


def test_every_sql_has_a_query():
    from duskrank.plans import oracles

    assert set(oracles.oracle_sql()) <= set(entry.queries())
