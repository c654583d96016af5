import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_core_stands_without_llm(monkeypatch):
    from shelfspark.plans import registry

    for name in [n for n in sys.modules if n.startswith("shelfspark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "shelfspark.llm", None)
    assert set(importlib.reload(entry).queries()) == set(registry.QUERIES)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["product_id", "valid_from_s"] and df.count() > 0


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "w1_hydration_plan", "k2_inventory_upsert", "st1_stream_upsert"])
def test_queries_run_on_the_smallest_tables(spark, name):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() >= 0
