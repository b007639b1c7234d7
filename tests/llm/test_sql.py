import pytest

import oracle
from millrace.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_operator_matches_sql(spark, name):
    oracle.check(spark, oracle.connection(SF), SF, queries.QUERIES[name], queries.ORACLES[name])
