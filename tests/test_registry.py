import pytest

from leafline.plans import registry
from leafline.plans.sql import SQL

from .conftest import same_as_sql


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, folder, name):
    same_as_sql(spark, duck, folder, registry.QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(SQL)))
def test_other_queries_run(spark, folder, name):
    assert registry.QUERIES[name](spark, folder).collect() is not None


def test_prompt_samples_cut_a_document_before_gathering_it(spark, folder, duck):
    df = registry.QUERIES["prompt_samples"](spark, folder)
    assert "row_number" in df._jdf.queryExecution().optimizedPlan().toString()
    same_as_sql(spark, duck, folder, registry.QUERIES["prompt_samples"], SQL["prompt_samples"])


def test_entry_names_are_registered():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
