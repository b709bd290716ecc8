from __future__ import annotations

import pytest

from oracle import assert_same
from pairloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, sf_dir, name):
    if name in registry.ORACLE_SQL:
        assert_same(spark, sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name])
    else:
        assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as engine

    assert engine.entry(spark).count() == 1
    assert set(engine.oracle_sql()) <= set(engine.queries())
