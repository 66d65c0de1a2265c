import pytest

import __spark_entry__
from akuru.plans import catalogue
from tests.oracle import same


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    same(spark, sf, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES])
def test_other_queries_run(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
