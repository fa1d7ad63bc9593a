"""Metrics and views over events, alerts, incidents and the analyst journal."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from secframe.functions.values import floor_div, micros
from secframe.operators.enrich import entity
from secframe.operators.skew import exact_median
from secframe.plans import settings as cfg

HALF_HOUR = 1_800_000_000
MEDIAN_BIN_S = 3600


def severity_counts(alerts_or_incidents: DataFrame) -> DataFrame:
    """Count per severity, zero-filled."""
    spark = alerts_or_incidents.sparkSession
    levels = spark.createDataFrame([(s, i) for i, s in enumerate(cfg.SEVERITIES)],
                                   "severity string, severity_rank int")
    found = alerts_or_incidents.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(found, "severity", "left").select(
        "severity", "severity_rank", F.coalesce("n", F.lit(0)).alias("n"))


def median_seconds(df: DataFrame, value: str, name: str) -> DataFrame:
    """Exact median of a whole-second column."""
    return exact_median(df.select(F.col(value).cast("bigint").alias(value)), value,
                        MEDIAN_BIN_S).withColumnRenamed("median", name)


def response_seconds(incidents: DataFrame) -> DataFrame:
    end = F.coalesce("closed_at", "contained_at")
    return incidents.filter(end.isNotNull()).select(
        "case_id", (F.unix_seconds(end) - F.unix_seconds("opened_at")).alias("seconds"))


def ops_metrics(events_count: int, incidents: DataFrame, plan: DataFrame, alerts: DataFrame,
                rules_df: DataFrame, run_seconds: float,
                lag_minutes: float = cfg.DETECTION_LAG_MINUTES) -> DataFrame:
    """One row of operations figures; every part is a scalar subquery over its own table."""
    mttr = median_seconds(response_seconds(incidents), "seconds", "m").scalar()
    raw = (median_seconds(alerts, "detection_latency_s", "m").scalar()
           if "detection_latency_s" in alerts.columns else F.lit(None).cast("double"))
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    total = count(rules_df)
    idle = count(idle_rules(rules_df, alerts))
    return incidents.sparkSession.range(1).select(
        F.lit(events_count).alias("events"), count(incidents).alias("incidents"),
        count(plan.filter(F.col("action") != "none")).alias("response_actions"),
        F.lit(int(lag_minutes * 60)).alias("mttd_seconds"), raw.alias("mttd_raw_seconds"),
        mttr.alias("mttr_seconds"),
        count(alerts.filter(F.col("score") >= 55)).alias("alerts_scored_ge_55"),
        F.round(F.lit(events_count) / F.lit(max(run_seconds, 0.001))).cast("bigint")
        .alias("throughput_eps"),
        F.round(100.0 * idle / F.greatest(F.lit(1), total), 1).alias("detection_gap_pct"))


# ---------------------------------------------------------------- analyst journal
JOURNAL_SCHEMA = ("case_id string, status string, assignee string, note string, "
                  "decided_at string")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Append-only decision lines with their order; unreadable lines are dropped later.

    A later decision time wins; without one, or at the same time, the younger file and then the
    later line do.
    """
    place = (F.col("_metadata.file_block_start")
             + F.monotonically_increasing_id().bitwiseAND(F.lit(2 ** 33 - 1)))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("age"),
                                         F.col("_metadata.file_path").alias("file"), place.alias("place"))
    rec = F.from_json(F.when(F.trim("value").endswith("}"), F.col("value")), JOURNAL_SCHEMA)
    at = F.try_to_timestamp(F.col("r.decided_at"))
    return lines.select("age", "file", "place", rec.alias("r")).select(
        F.struct(at.alias("at"), "age", "file", "place").alias("seq"), "r.*")


def latest_decisions(journal: DataFrame, key: str = "case_id", order: str = "seq") -> DataFrame:
    """Last decision per case; lines without a case id do not count."""
    rest = [c for c in journal.columns if c not in (key,)]
    return (journal.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key)
            .agg(F.max_by(F.struct(*rest), order).alias("d")).select(key, "d.*"))


def apply_decisions(incidents: DataFrame, decisions: DataFrame, now) -> DataFrame:
    """Fold the latest decisions into the incidents."""
    d = decisions.select("case_id", F.col("status").alias("_status"),
                         F.col("assignee").alias("_assignee"), F.col("note").alias("analyst_note"))
    fp = F.coalesce(F.col("_status") == "false-positive", F.lit(False))
    decided = F.col("_touched").isNotNull()
    status = F.when(fp, "closed").otherwise(F.coalesce("_status", "status"))
    at = F.lit(now).cast("timestamp")
    return (incidents.join(d.withColumn("_touched", F.lit(1)), "case_id", "left")
            .withColumn("false_positive", fp)
            .withColumn("fp_rule", F.when(fp, F.get("rules", F.lit(0))))
            .withColumn("closed_at", F.when(fp, at).when(
                decided & (status == "closed") & F.col("closed_at").isNull(), at)
                .otherwise(F.col("closed_at")))
            .withColumn("status", F.when(decided, status).otherwise(F.col("status")))
            .withColumn("assignee", F.when(decided, F.coalesce(
                "_assignee", "assignee", F.lit("analyst.onshift"))).otherwise(F.col("assignee")))
            .drop("_status", "_assignee", "_touched"))


# ---------------------------------------------------------------- views
def half_hour_timeline(events: DataFrame, alerts: DataFrame, last: int = 40) -> DataFrame:
    """Events, alerts and critical alerts per half hour; the newest ``last`` buckets."""
    bucket = lambda c: (floor_div(micros(F.col(c)), HALF_HOUR) * HALF_HOUR).alias("bucket")
    per_event = events.groupBy(bucket("ts")).agg(F.count(F.lit(1)).alias("events"))
    per_alert = alerts.groupBy(bucket("first_seen")).agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count_if(F.col("severity") == "critical").alias("critical"))
    both = per_event.unionByName(per_alert, allowMissingColumns=True).groupBy("bucket").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("events", "alerts", "critical")])
    newest = both.orderBy(F.col("bucket").desc()).limit(last)
    return newest.withColumn("bucket", F.timestamp_micros("bucket")).orderBy("bucket")


def rule_coverage(rules_df: DataFrame, alerts: DataFrame) -> DataFrame:
    hits = alerts.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    return rules_df.join(hits, "rule_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def idle_rules(rules_df: DataFrame, alerts: DataFrame) -> DataFrame:
    return rules_df.join(alerts.select("rule_id").distinct(), "rule_id", "left_anti")


def tactic_coverage(rules_df: DataFrame, alerts: DataFrame) -> DataFrame:
    fired = rule_coverage(rules_df, alerts).withColumn("fired", (F.col("hits") > 0).cast("int"))
    return fired.groupBy("tactic").agg(F.count(F.lit(1)).alias("rules"),
                                       F.sum("fired").alias("fired"))


def attack_coverage(alerts: DataFrame) -> DataFrame:
    """Distinct tactics and techniques seen in alerts."""
    flat = alerts.select("tactic", F.explode_outer("technique").alias("technique"))
    return flat.agg(F.count_distinct("tactic").alias("tactics"),
                    F.count_distinct("technique").alias("techniques"))


def evidence_export(alerts: DataFrame, incidents: DataFrame, membership: DataFrame) -> DataFrame:
    """Flat alert rows with their incident, joined on the alert itself."""
    joined = [F.coalesce(F.array_join(entity(k), ", "), F.lit("")).alias(n)
              for k, n in (("user_name", "user"), ("host_name", "host"), ("source_ip", "source_ip"),
                           ("destination_domain", "dest_domain"), ("process_name", "process"))]
    case = membership.join(incidents.select("component", "case_id", "status"), "component")
    return (alerts.join(case, "alert_id", "left")
            .select(F.coalesce("case_id", F.lit("")).alias("case_id"), "score", "severity",
                    "confidence", "rule_id", "rule_name", "tactic",
                    F.array_join("technique", ",").alias("technique"), "first_seen", "last_seen",
                    F.col("count").alias("events"), F.coalesce("status", F.lit("open"))
                    .alias("status"), *joined))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def kpi_row(alerts: DataFrame, incidents: DataFrame, plan: DataFrame, loss: DataFrame | None = None,
            timeline: DataFrame | None = None) -> DataFrame:
    one = lambda df, c: df.agg(c).scalar()
    count = F.count(F.lit(1))
    cols = [one(alerts, count).alias("alerts"), one(incidents, count).alias("incidents"),
            one(alerts, F.count_distinct("rule_id")).alias("rules_fired"),
            one(plan, F.count_if(F.col("action") != "none")).alias("auto_actions"),
            one(incidents, F.round(100.0 * F.count("contained_at")
                                   / F.greatest(F.lit(1), count))).alias("containment_rate")]
    cols += [one(alerts, F.count_if(F.col("severity") == s)).alias(f"sev_{s}")
             for s in cfg.SEVERITIES]
    if "false_positive" in incidents.columns:
        cols += [one(incidents, F.count_if("false_positive")).alias("fp_count"),
                 one(incidents, F.array_sort(F.collect_set("fp_rule"))).alias("fp_rules")]
    if loss is not None:
        cols += [one(loss, F.sum("parse_errors")).alias("parse_errors"),
                 one(loss, F.sum("parsed")).alias("events"), one(loss, count).alias("sources")]
    if timeline is not None:
        cols += [one(timeline, F.min("bucket")).alias("window_start"),
                 one(timeline, F.max("bucket")).alias("window_end")]
    return alerts.sparkSession.range(1).select(*cols)


def top_alerts(alerts: DataFrame, n: int = 25) -> DataFrame:
    return alerts.orderBy(F.col("score").desc(), "first_seen", "alert_id").limit(n)


def false_positive_candidates(alerts: DataFrame, n: int = 6) -> DataFrame:
    return alerts.orderBy("score", "first_seen", "alert_id").limit(n)


def incidents_by_score(incidents: DataFrame, n: int = 25) -> DataFrame:
    return incidents.orderBy(F.col("score").desc(), "opened_at", "case_id").limit(n)
