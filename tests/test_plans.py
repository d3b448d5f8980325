"""Plan hygiene of every registered query: JVM-side only, no pair-producing joins."""

import re

import pytest

from ratelens.plans.registry import ORACLE, QUERIES

from conftest import SF_SMALL

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "CartesianProduct",
             "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_plan_has_no_python_and_no_pair_joins(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{key}: {op}"


def test_filter_and_projection_reach_the_scan(spark):
    df = QUERIES["faceted_filter"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[dept#\d+ IN \(F,O\)\]", plan)
    assert "PushedFilters: [IsNotNull(age), IsNotNull(income), In(travel" in plan
    assert "ReadSchema: struct<row_id:string,y:int,travel:string,age:int,income:double>" in plan


ROW_KEYS = {"describe": ["variable"], "box_stats": ["variable"], "equity_within_level": ["level"], "f1_gap": ["row_id"],
            "rate_by_dept": ["row_id"], "final_summary": ["row_id"]}


@pytest.mark.parametrize("key", sorted(ROW_KEYS))
def test_rows_are_not_shuffled_by_few_valued_keys(spark, key):
    """The plan that ran, with static broadcasts as sizes allow: no exchange of whole rows on such keys."""
    df = QUERIES[key](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    for name in ROW_KEYS[key]:
        for line in re.findall(r"Exchange hashpartitioning\(" + name + r"#.*", final):
            below = final[final.index(line):].split("\n")[1]
            assert "partial" in below or "HashAggregate" in below or "Project" in below, (key, line, below)


def test_flagship_scans_once(spark):
    df = QUERIES["rate_by_dept"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2 and plan.split("== Initial Plan ==")[0].count("FileScan") == 1


def test_lineitem_rows_meet_two_growing_tables(spark):
    """Orders meet their customers first: lineitem rows are shuffled for their part and for their order, not for the customer."""
    from ratelens.sources.tables import fact_frame
    node = fact_frame(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan()

    def joins_above_lineitem(n):
        below = [joins_above_lineitem(n.children().apply(i)) for i in range(n.children().size())]
        own = [b for b in below if b is not None]
        if not below:
            return 0 if "l_orderkey" in n.output().toString() else None
        return own[0] + (n.nodeName() == "Join") if own else None

    assert joins_above_lineitem(node) == 2
