"""Every query with SQL gives DuckDB's rows; the others give rows with a stable schema."""

import pytest
from compare import difference, duck
from tallyspark.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, connection, name):
    assert not difference(catalog.queries()[name](spark, SF), connection, catalog.oracle_sql()[name])


def test_verification_pairs(spark):
    rows = catalog.queries()["smp04_verification_pairs"](spark, SF).collect()
    assert len(rows) == 200 and sum(r.label for r in rows) == 100
    assert all(r.id_a < r.id_b for r in rows) and len({(r.id_a, r.id_b) for r in rows}) == 200
