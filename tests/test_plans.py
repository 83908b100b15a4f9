"""Physical plans: what must and must not appear."""

import os
import re

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
# Streams and folds that write intermediate results run when they are built.
LAZY = [n for n in entry.queries() if not n.startswith("stream_") and n not in ("incident_timeline", "chain_nodes", "chain_edges")]


DEFAULT = [
    "pattern_hits", "password_spray", "telemetry_gap", "ueba_findings", "mad_outliers", "ueba_risk", "anomalies", "ioc_enrich",
    "auto_blocks", "site_kpis", "zt_sessions", "case_current", "alert_log", "control_status", "readiness", "framework_matrix",
]
CHOSEN = LAZY if os.environ.get("ALL_QUERIES") else DEFAULT


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHOSEN)
def test_no_cross_join_and_no_single_task_window(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # A window without partition columns would print an empty partition list.
    for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan):
        first = spec.split(",")[0]
        assert " ASC " not in first and " DESC " not in first, spec


def test_scan_is_pruned_and_filtered(spark):
    plan = plan_of(entry.queries()["ueba_new_ip"](spark, SF_DIR))
    assert "event_type" in plan and "value" not in re.search(r"ReadSchema: (\S+)", plan).group(1)


def test_sliding_rules_shuffle_once(spark):
    for name in ("bruteforce_windows", "password_spray", "distributed_bruteforce", "impossible_travel", "exfil_bursts"):
        plan = plan_of(entry.queries()[name](spark, SF_DIR))
        assert len(re.findall(r"\bExchange ", plan)) == 1, name
