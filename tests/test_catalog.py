import pytest

from textmill.plans import catalog

from .conftest import DATA
from .sqlcheck import assert_same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, name, catalog.queries()[name], catalog.oracle_sql()[name], DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert catalog.queries()[name](spark, str(DATA / "sf0.001")).count() > 0


def test_every_floor_rule_fires(spark):
    row = catalog.queries()["floor_counts"](spark, str(DATA / "sf0.001")).groupBy().sum("blank", "separator", "heartbeat", "duplicate").first()
    assert all(n > 0 for n in row)


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
