import pytest

from litmill.plans import catalogue
from tests import harness


@pytest.fixture(scope="module")
def duck():
    con = harness.connect("/root/testdata/sf0.001")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_its_sql(spark, sf, duck, name):
    if name in catalogue.ORACLE_SQL:
        assert harness.differences(spark, duck, sf, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name]) == ""
    else:
        assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
