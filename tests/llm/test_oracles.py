import os

import pytest

from tests import oracle
from tuplewright import llm

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(llm.oracles()))
def test_query_equals_its_sql(spark, name):
    assert oracle.same(spark, oracle.connect(SF), llm.queries()[name], llm.oracles()[name], SF) > 0
