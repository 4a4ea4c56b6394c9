import pytest
from compare import duck, same

from spanloom.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "score" in e.entry(spark).columns
