"""Every registered query equals its SQL on the small tables."""

import pytest
from compare import connect, difference

from aeroband.plans import catalog
from aeroband.plans.registry import ENTRIES

SF = "/root/testdata/sf0.001"
catalog.load()
# Training is covered by tests/test_learning.py; it dominates the run time here.
SLOW = {"p11_random_forest", "p12_gradient_boosted", "p13_grid_search", "p13_random_search"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in ENTRIES if n not in SLOW])
def test_query(spark, con, name):
    found = difference(spark, con, SF, name)
    assert found is None or found == "empty result", found


def test_contract():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 400
