"""Every query against its SQL on the smallest tables; the entry point; the guard for absent parts."""

import pytest

from boutwright.plans import registry
from tests.compare import connect, same
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
#: Queries with no row on the smallest tables, in Spark and SQL alike; held to rows on the next size.
SPARSE, WIDER = {"conflict_reconcile"}, f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    if name in SPARSE:
        assert same(spark, connect(WIDER), registry.queries()[name], registry.oracle_sql()[name], WIDER) == ""
    else:
        assert same(spark, con, registry.queries()[name], registry.oracle_sql()[name], SF) == ""


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_runs_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "diff_ewm_won" in df.columns
