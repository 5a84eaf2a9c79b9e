"""Every core query with an SQL counterpart gives the same rows as DuckDB on the smallest tables."""

import pytest

from tools.compare import compare, views
from weftline.plans import catalogue


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    text, ok = compare(spark, views(sf), sf, name)
    assert ok, text


def test_every_core_query_without_sql_runs(spark, sf):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert catalogue.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_name_the_training_data_package():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "weftline"
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert "weftline.llm" not in p.read_text(), p
