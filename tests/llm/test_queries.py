import pytest

from eventloom.llm.queries import QUERIES, SQL
from tests.conftest import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    compare(QUERIES[name](spark, sf), SQL[name], sf)
