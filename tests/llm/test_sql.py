"""Text queries that have SQL, against it over whole tables."""

import pytest
from compare import difference, duck
from tallyspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, name, size):
    at = f"/root/testdata/{size}"
    assert not difference(queries.queries()[name](spark, at), duck(at), queries.oracle_sql()[name])
