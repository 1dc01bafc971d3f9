import pytest

from llm_oracle import assert_equal
from quire.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert_equal(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_one_row_for_each_input_row(spark, name):
    table = "pages" if name.startswith("op8") else "documents"
    assert queries.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
