"""Plan shapes that must hold for every registered query, whatever the data size."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry
from tests.compare import DATA
from workload.registry import QUERIES

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")

# acts while it is built: a preview runs its steps
EAGER = {"k20_preview"}
PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow")


def plan_of(spark, name: str) -> str:
    df = entry.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_products_and_no_python(spark, name):
    plan = plan_of(spark, name)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", *PYTHON):
        assert node not in plan, node


@pytest.mark.parametrize("name", ["k15_sort_numeric_desc", "k5_fill_ffill", "k6_fill_bfill", "s1_row_numbers", "h8_anomaly_list", "k3_fill_median"])
def test_numbering_and_filling_write_nothing(spark, name, monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("a plan was written while the query was built")

    monkeypatch.setattr("tidymill.session.pin", refused)
    plan = plan_of(spark, name)
    assert set(re.findall(r"InMemoryFileIndex[^\n]*?file:([^\], ]*)", plan)) <= {f"{FOLDER}/orders.parquet", f"{FOLDER}/customer.parquet"}


@pytest.mark.parametrize("name", ["k5_fill_ffill", "k6_fill_bfill", "s1_row_numbers", "h8_anomaly_list"])
def test_windows_without_a_partition_see_groups_of_blocks_only(spark, name):
    plan = plan_of(spark, name)
    alone = [w for w in re.findall(r"\+- Window \[(.*)", plan) if "windowspecdefinition(_group" in w]
    every = re.findall(r"windowspecdefinition\(([^,)]*?) (?:ASC|DESC)", plan)
    assert alone and all(key.startswith("_group") for key in every), every


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("l7_pv_uv", {"ts", "user_id", "event_type"}),
        ("l9_group_median", {"o_totalprice", "o_orderpriority"}),
        ("l10_repurchase_rate", {"o_orderkey", "o_custkey"}),
        ("a2_calc_count_nonnull", {"o_orderkey", "o_orderpriority"}),
        ("e1_event_summary", {"event_type"}),
    ],
)
def test_scans_read_only_the_columns_they_need(spark, name, columns):
    df = entry.queries()[name](spark, FOLDER)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    physical = df._jdf.queryExecution().executedPlan()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", physical.toString())
    assert schemas, text
    for schema in schemas:
        read = {c.split(":")[0] for c in schema.split(",")}
        assert read <= columns or "..." in schema, schema


@pytest.mark.parametrize("name", ["l4_group_top_n", "k7_drop_duplicates_by", "h17_latest_profile"])
def test_group_limits_apply_before_the_shuffle(spark, name):
    plan = plan_of(spark, name)
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_filters_reach_the_scan(spark):
    plan = plan_of(spark, "t2_page_after")
    assert re.search(r"PushedFilters: \[.*LessThan\(o_orderkey,1000\)", plan)
