"""Every registered query of the subpackage runs over whole tables; those with SQL agree with it."""

from pathlib import Path

import pytest
from oracle import ROOT, agree, connection

from folioscale.llm import queries
from folioscale.session import local_session, ship

pytestmark = pytest.mark.skipif(not Path(ROOT).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def spark():
    return ship(local_session(4, 4, "2g"))


@pytest.mark.parametrize("name", queries.queries())
def test_query(name, spark):
    query, sql = queries.queries()[name], queries.oracle_sql().get(name)
    if sql:
        agree(query, sql, spark, connection())
    else:
        assert query(spark, ROOT).limit(1).count() == 1


@pytest.mark.parametrize("number", range(1, 10))
def test_every_problem_has_a_query(number):
    assert any(n.startswith(f"p{number}_") for n in queries.queries())
