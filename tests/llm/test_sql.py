import pytest
from oracle import compare

from rastrum.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)
