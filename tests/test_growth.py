"""Plans that have to hold on large tables: no side of pages is broadcast, costly rows are dealt out and worked out once."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioframe.operators import edits, learning

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["arrow_changes", "arrow_trims", "confusable_repair", "find_inconsistent", "edit_history"])
def test_no_side_of_pages_is_broadcast(spark, name):  # F4, F5, F6, F7
    assert "BroadcastExchange" not in plan(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["edit_script", "wide_gaps"])
def test_costly_rows_are_dealt_out(spark, name):  # F2, F3
    assert "RoundRobinPartitioning" in plan(entry.queries()[name](spark, SF))


def test_gaps_are_no_filter(spark):  # a pushed filter holds the whole chain, nested
    assert not [line for line in plan(entry.queries()["wide_gaps"](spark, SF)).splitlines() if "Filter" in line and "lambda" in line]


def test_script_is_worked_out_once(spark):  # F10
    changed = spark.createDataFrame([("a1b", "axb")], "old string, new string")
    assert plan(edits.short_fixes(changed)).count("ArrowEvalPython") == 1


def test_fixes_are_learned_once(spark, monkeypatch):  # no count of the fixes before they are applied
    monkeypatch.setattr(edits, "MOST_FIXES", 1)
    table = spark.createDataFrame([("ab", "ac", 2), ("cd", "ce", 2)], "wrong string, right string, n long")
    lines = spark.createDataFrame([("ab", False)], "text string, has_chars boolean")
    out = edits.with_fixes(lines, table)  # counts nothing
    with pytest.raises(Exception, match="2 trusted fixes; 1 can be applied"):
        out.collect()
    monkeypatch.setattr(edits, "MOST_FIXES", 2)
    assert [r.fixed for r in edits.with_fixes(lines, table).collect()] == ["ac"]


def test_equal_boxes_are_left_alone_by_id(spark):  # F8
    box = "page int, id int, x int, y int, w int, h int"
    auto = spark.createDataFrame([(1, 1, 0, 0, 9, 9), (1, 2, 0, 0, 9, 9)], box).withColumns({"kind": F.lit("icon"), "state": F.lit("kept")})
    drawn = spark.createDataFrame([], box + ", kind string")
    assert learning.edit_history(auto, auto.where("id = 1"), drawn).collect() == [(1, 2, 1)]
    assert learning.edit_history(auto, auto.where("id = 1").drop("id"), drawn).collect() == [(1, 2, 0)]
