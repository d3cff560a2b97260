"""Every registered query of the engine against its oracle."""

import pytest

import __spark_entry__ as entry
from corpusledger.plans import catalogue
from tests.oracle import duck, same


@pytest.fixture(scope="module")
def db(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_oracle(spark, data, db, name):
    result = catalogue.QUERIES[name](spark, data)
    if name in catalogue.ORACLES:
        same(result, db, catalogue.ORACLES[name])
    else:
        assert result.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
