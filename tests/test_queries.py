import pytest

from shelfmark.plans import registry as catalog

from .compare import connect, same_rows

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(name, spark, sf_dir, con):
    same_rows(catalog.queries()[name](spark, sf_dir), con, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
