"""Every registered core query that SQL can express agrees with its SQL; the others give rows."""

from pathlib import Path

import pytest
from oracle import ROOT, agree, connection

from folioscale.plans import registry
from folioscale.session import local_session, ship

pytestmark = pytest.mark.skipif(not Path(ROOT).is_dir(), reason="no test tables here")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def spark():
    return ship(local_session(4, 4, "2g"))


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_agrees_with_its_sql(name, spark, con):
    agree(QUERIES[name], SQL[name], spark, con)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_without_sql_gives_rows(name, spark):
    assert QUERIES[name](spark, ROOT).limit(1).count() == 1


def test_every_query_has_its_place():
    assert set(SQL) <= set(QUERIES) and not any(n.startswith("p") for n in QUERIES)
