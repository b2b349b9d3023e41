import importlib
import sys

import __spark_entry__ as entry
from riskloom.runtime import cut, join_measured


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_llm_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "riskloom.llm", None)
    monkeypatch.setitem(sys.modules, "riskloom.llm.queries", None)
    module = importlib.reload(entry)
    names = set(module.queries())
    monkeypatch.undo()
    importlib.reload(entry)
    assert "p7_found" in names and "jit_features" in names and "p8_ids" not in names


def test_cut_and_measured_joins(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as string) k")
    small = cut(df.where("id < 3").select("k"))
    assert small.count() == 3 and join_measured(df, small, ["k"]).count() == df.where("k < '3'").count()
