"""Every query with SQL against DuckDB; the others must give rows."""

import pytest
from oracle import same

from tideline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert same(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf) > 0


@pytest.mark.parametrize("name", ["flagship_current_state", "m16_all_methods", "t09_triggers", "x09_compare", "x12_frontier", "h14_boosted", "h15_h20_switching"])
def test_query_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_module_registers_everything(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 3
