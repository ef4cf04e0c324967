"""Every catalogue query: no nested-loop or cartesian joins, and a
single-partition exchange only where it is expected and bounded."""

import pytest

from tablesteps.plans import catalogue as C

from conftest import SF_SMALL

# Queries whose plans may hold a SinglePartition exchange, and why.
SINGLE_PARTITION_OK = {
    # the window over per-partition counts of the dense row index: one row per partition
    "api_payload_batches": "row index",
    "batch_ids": "row index",
    "order_by_chain": "row index",
    "order_by_desc": "row index",
    "row_helpers": "row index",
    "skip_rows": "row index",
    "skip_take_page": "row index",
    "doc_find": "row index (skip and limit)",
    "group_members": "row index over one row per group",
    "group_rows_tagged": "row index over one row per group",
    "tables_equivalent_ordered": "row index (both sides) + global count",
    # final step of a global aggregate: one partial row per task
    "row_count": "global count",
    "rest_page_requests": "global count",
    "conform_report": "global count",
    "tables_equivalent": "global count",
}

C.load_all()
NAMES = sorted(C.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_plan_shape(spark, name):
    df = C.QUERIES[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    if name not in SINGLE_PARTITION_OK:
        assert "SinglePartition" not in plan, plan
