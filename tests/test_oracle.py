"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest
from conftest import SF

from plumbline import plans


@pytest.mark.parametrize("name", sorted(plans.all_queries()))
def test_query_matches_sql(spark, duck, name):
    text, ok = compare.compare(spark, duck, name, plans.all_queries()[name], plans.all_oracles().get(name), SF)
    assert ok, text
