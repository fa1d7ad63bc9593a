"""Headline queries, timed.  Prints one JSON line.

BENCH_SF_DIR picks the data (default sf0.1), BENCH_CPUS the local threads.
"""
import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "threshold_errors", "distinct_threshold", "sequence_prior", "sequence_cooldown",
    "impossible_travel", "beaconing", "multi_rule_hits", "single_event_alerts", "alert_rows",
    "full_rule_pack", "ingest_json", "ingest_apache", "ingest_syslog", "ingest_csv", "ingest_loss",
    "pred_regex", "geo_lpm", "alert_score", "alert_edges_by_time", "alert_components",
    "incident_rows", "response_plan", "timeline_30m", "latest_decision",
]


def main():
    from pyspark.sql import SparkSession
    from secframe.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("secframe-bench")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["threshold_errors"](spark, sf_dir).count()      # start the JVM before timing
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
