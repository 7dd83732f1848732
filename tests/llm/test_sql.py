"""The queries that SQL can express, against their SQL."""

import pytest

from countloom.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, name):
    assert not differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name])
