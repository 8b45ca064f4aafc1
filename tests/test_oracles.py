"""Every query that has a SQL twin gives the same rows."""

import pytest

from tests.comparing import connect, same
from tests.conftest import SMALL
from verivane.plans.ledger_queries import QUERIES, flagship
from verivane.plans.ledger_sql import ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    same(QUERIES[name](spark, SMALL), duck, ORACLE_SQL[name])


def test_all_queries_but_trained_models_have_a_twin():
    assert set(QUERIES) - set(ORACLE_SQL) == {"gbt_forecast", "walkforward_gbt", "walkforward_gbt_summary", "walkforward_ridge"}


def test_flagship(spark):
    rows = flagship(spark, SMALL).collect()
    assert len(rows) == 5 and all(r["scored"] >= 0 for r in rows)
