"""Every query of the core against its SQL, over whole small tables."""

import pytest

from lorevine.plans import general, notes
from tests.compare import DATA, connect, differences

MODULES = (general, notes)
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.ORACLES])
def test_same_rows(spark, con, name):
    query, sql = next((m.QUERIES[name], m.ORACLES[name]) for m in MODULES if name in m.ORACLES)
    extra, missing = differences(query(spark, str(DATA)), con, sql)
    assert not extra and not missing


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.QUERIES if n not in m.ORACLES])
def test_runs_without_sql(spark, name):
    query = next(m.QUERIES[name] for m in MODULES if name in m.QUERIES)
    assert query(spark, str(DATA)).count() > 0


def test_entry_registers_all():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
