import pytest

from leafline.llm.queries import QUERIES, SQL

from ..conftest import same_as_sql


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, folder, name):
    same_as_sql(spark, duck, folder, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", ["p6_ids", "p7_containers", "p8_rates"])
def test_others_run(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0
