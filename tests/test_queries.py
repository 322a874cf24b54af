"""Every query with SQL gives what the SQL gives."""

import pytest

from sieveloom.plans import extra
from sieveloom.plans.registry import PLANS

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plan(spark, duck, same, name):
    same(PLANS[name].spark(spark, DATA).toPandas(), duck.execute(PLANS[name].duck()).df())


@pytest.mark.parametrize("name", sorted(extra.EXTRA))
def test_extra(spark, duck, same, name):
    got = extra.EXTRA[name](spark, DATA).toPandas()
    if name in extra.ORACLE:
        same(got, duck.execute(extra.ORACLE[name]).df())
    else:
        assert len(got)


def test_entry_has_all(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
