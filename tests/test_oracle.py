"""Every registered event query agrees with its SQL on the smallest tables; those without SQL run and give rows."""

import pytest

from fieldglass import registry

from .oracle import connect, differences

HERE = "/root/testdata/sf0.001"
#: Queries that may find nothing in tables of this size.
MAY_BE_EMPTY = {"flux_departed", "flux_emerging", "alerts_volume_orders_country", "alerts_actor_orders_country", "alerts_place_orders_country"}


@pytest.fixture(scope="module")
def db():
    return connect(HERE)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, db, name):
    assert differences(registry.QUERIES[name](spark, HERE), db, registry.ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    rows = registry.QUERIES[name](spark, HERE).collect()
    assert rows or name in MAY_BE_EMPTY
