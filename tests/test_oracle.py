import pytest
from oracle import check

from lexigrid.plans.catalog import catalog

CATALOG = catalog()


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, name):
    check(spark, *CATALOG[name], "/root/testdata/sf0.001")
