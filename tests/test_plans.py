"""Plans are the ones meant: equi-joins for ranges, pruned scans, pushed filters, limits inside the tasks."""

import os
import re

import pytest

from lumiquarry.plans import registry

SF = os.environ.get("LUMIQUARRY_TESTDATA", "/root/testdata/sf0.001")


def plan(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["burst_pairs", "place_interval", "place_photos", "nearest_place", "landmark_radius", "top_locations", "best_overlap"])
def test_range_joins_are_equi_joins(spark, name):
    p = plan(spark, name)
    assert "NestedLoop" not in p and "Cartesian" not in p and "Join" in p


@pytest.mark.parametrize("name,columns", [("tag_counts", {"event_type"}), ("exact_dups", {"doc_id", "text", "n_chars"}), ("rename_label", {"o_orderkey", "o_orderpriority"}), ("sql_day_counts", {"ts"})])
def test_scans_read_what_is_used(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name))
    assert {c.split(":")[0] for r in read for c in r.split(",")} == columns


def test_filters_reach_the_scan(spark):
    assert "GreaterThan(value,40.0)" in plan(spark, "top_places") and "EqualTo(quality,1)" in plan(spark, "liked_semi")


@pytest.mark.parametrize("name", ["primary_tag", "top_per_day"])
def test_best_rows_are_limited_before_the_shuffle(spark, name):
    p = plan(spark, name)
    assert p.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["vector_topk", "photo_list_page"])
def test_pages_are_taken_in_the_tasks(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)
