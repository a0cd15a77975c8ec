"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as contract
from cycle_analytics.plans import ORACLES, QUERIES
from cycle_analytics.session import clear_work, folder_names, shared_root
from tests.oracle import database, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert differences(con, contract.queries()[name](spark, sf_dir), contract.oracle_sql()[name]) == []


def test_work_folders_can_be_removed(spark, sf_dir):
    assert contract.queries()["cycle_inventory"](spark, sf_dir).count() > 0
    assert any(name.startswith("packages-") for name in folder_names(spark, shared_root(spark)))
    assert clear_work(spark) > 0 and clear_work(spark) == 0


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
