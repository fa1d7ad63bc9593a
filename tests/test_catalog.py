"""Registered queries against their SQL on the smallest data set."""
import os

import pytest

from compare import spark_rows, sql_rows
from secframe.catalog import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FAST = ["threshold_errors", "distinct_threshold", "sequence_cooldown", "impossible_travel", "beaconing",
        "multi_rule_hits", "single_event_alerts", "alert_rows", "ingest_json", "ingest_csv", "timestamp_formats",
        "ip_flags", "geo_lpm", "pred_filter", "alert_score", "alert_edges", "alert_edges_by_time", "incident_rows",
        "median_latency", "timeline_30m", "latest_decision", "stream_threshold", "stream_sequence"]


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, name):
    assert spark_rows(spark, SF, QUERIES[name]) == sql_rows(SF, SQL[name])
