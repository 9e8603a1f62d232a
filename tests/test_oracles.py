import os

import pytest

from tests import oracle
from tuplewright import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    oracle.same(spark, duck, catalog.queries()[name], catalog.oracle_sql()[name], SF)
