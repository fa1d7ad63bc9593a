"""Registry and the security-shaped views derived from the driver tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from secframe.functions.net import is_internal

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows of a table that is a single small file, dealt to all cores; larger tables are cut by the scan.

    The number is given, so adaptive execution does not fold the partitions again.
    """
    if len(df.inputFiles()) != 1:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def events(spark, sf_dir) -> DataFrame:
    """The event stream with a UTC timestamp and a total order."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("event_seq", F.col("event_id"))


def secs(c) -> Column:
    return F.unix_seconds(F.col(c) if isinstance(c, str) else c)


# the same text runs in both engines; only the two helpers differ
_SPARK = {"secs": "unix_seconds(CAST(ts AS TIMESTAMP))", "k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"}
_DUCK = {"secs": "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)",
         "k": "CAST(regexp_extract(props, '[0-9]+') AS INT)"}

_CAPTURE = [
    ("event_seq", "event_id"),
    # a month of events squeezed into 3.6 hours, so minute-sized rule windows fill up
    ("ts_s", "1704067200 + CAST(floor(({secs} - 1704067200) / 200) AS BIGINT)"),
    ("event_dataset", "CASE event_type WHEN 'click' THEN 'proxy' WHEN 'view' THEN 'web' "
                      "WHEN 'purchase' THEN 'firewall' ELSE 'authentication' END"),
    ("event_action", "CASE event_type WHEN 'error' THEN 'failed-logon' WHEN 'signup' THEN "
                     "'successful-logon' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'deny' "
                     "ELSE 'allow' END ELSE 'http-request' END"),
    ("source_ip", "CASE user_id % 10 WHEN 0 THEN '203.0.113.44' WHEN 1 THEN '45.155.205.10' "
                  "WHEN 2 THEN '198.51.100.23' WHEN 3 THEN '103.216.220.' || (user_id % 250) "
                  "WHEN 4 THEN '104.28.55.' || (event_id % 250) WHEN 5 THEN '10.10.31.27' "
                  "WHEN 6 THEN '10.10.31.44' WHEN 7 THEN '203.0.113.77' "
                  "WHEN 8 THEN '192.0.2.' || (user_id % 250) "
                  "ELSE '10.20.' || (user_id % 200) || '.' || (event_id % 250) END"),
    ("user_name", "CASE WHEN user_id % 17 = 0 THEN 'svc-' || user_id WHEN user_id % 13 = 0 THEN "
                  "'admin' || user_id ELSE 'user' || (user_id % 400) END"),
    ("host_name", "CASE user_id % 5 WHEN 0 THEN 'SRV-' || (user_id % 50) WHEN 1 THEN 'DC-01' "
                  "WHEN 2 THEN NULL ELSE 'WS-' || (user_id % 90) END"),
    ("destination_ip", "CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN "
                       "'10.10.20.30' ELSE '198.51.100.' || (event_id % 200) END END"),
    ("destination_port", "CASE WHEN event_type = 'purchase' THEN CAST(400 + {k} AS BIGINT) END"),
    ("destination_domain", "CASE WHEN event_type = 'click' THEN CASE {k} % 9 WHEN 0 THEN "
                           "'cdn-update-service.net' WHEN 1 THEN 'a.exfil-drop.cloud' WHEN 2 THEN "
                           "'notexfil-drop.cloud' ELSE 'site' || ({k} % 9) || '.example' END END"),
    ("process_name", "CASE WHEN event_type IN ('click', 'view') THEN CASE {k} % 4 WHEN 0 THEN "
                     "'chrome.exe' WHEN 1 THEN 'svcmon.exe' WHEN 2 THEN 'powershell.exe' ELSE "
                     "'teams.exe' END END"),
    ("url_path", "CASE WHEN event_type = 'view' THEN CASE {k} % 10 WHEN 0 THEN '/owa/auth.owa' "
                 "WHEN 1 THEN '/gate.php' WHEN 2 THEN '/.env' ELSE '/page/' || {k} END END"),
    ("http_response_status_code", "CASE WHEN event_type = 'view' THEN CAST(CASE WHEN {k} % 10 = 0 "
                                  "THEN 401 ELSE 200 END AS BIGINT) END"),
    ("network_bytes", "CAST(round(value * 100) AS BIGINT) * 10000"),
    ("network_direction", "CASE WHEN event_type IN ('click', 'purchase') THEN 'outbound' END"),
]
CAPTURE_SQL = ("cap AS (SELECT " + ", ".join(f"{e.format(**_DUCK)} AS {n}" for n, e in _CAPTURE)
               + ", user_id, event_type FROM events)")


def capture(spark, sf_dir) -> DataFrame:
    """Events dressed as normalized security events (canonical columns)."""
    e = spread(table(spark, sf_dir, "events"))
    df = e.selectExpr(*[f"{x.format(**_SPARK)} AS {n}" for n, x in _CAPTURE], "user_id", "event_type")
    return df.withColumns({
        "ts": F.timestamp_seconds("ts_s"),
        "source_ip_not_private": ~is_internal(F.col("source_ip")),
        "destination_ip_not_private": ~is_internal(F.col("destination_ip"))})


# one alert per (kind, user, day) with at least two events: the input of the alert-side queries
_ALERT = [
    ("alert_id", "event_type || '-' || user_id || '-' || day"),
    ("rule_id", "CASE event_type WHEN 'error' THEN 'R-ERR' ELSE 'R-BUY' END"),
    ("severity", "CASE user_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' "
                 "WHEN 3 THEN 'low' ELSE 'informational' END"),
    ("confidence", "CASE user_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"),
    ("risk", "CAST(40 + user_id % 60 AS INT)"),
    ("tactic", "CASE WHEN event_type = 'purchase' THEN 'lateral-movement' WHEN user_id % 4 = 0 THEN "
               "'credential-access' WHEN user_id % 4 = 1 THEN 'exfiltration' WHEN user_id % 4 = 2 "
               "THEN 'discovery' ELSE 'collection' END"),
    ("n", "n"), ("first_s", "first_s"), ("last_s", "last_s"), ("mx", "mx"),
    ("prior_events", "CASE WHEN n >= 3 THEN n END"),
    ("user_name", "CASE WHEN user_id % 17 = 0 THEN 'svc-' || user_id WHEN user_id % 13 = 0 THEN "
                  "'admin' || user_id ELSE 'user' || user_id END"),
    ("host_name", "CASE WHEN user_id % 6 = 0 THEN NULL WHEN user_id % 6 = 1 THEN 'SRV-' || "
                  "(user_id % 50) ELSE 'WS-' || (user_id % 90) END"),
    ("source_ip", "CASE user_id % 10 WHEN 0 THEN '203.0.113.44' WHEN 1 THEN '45.155.205.' || "
                  "(user_id % 200) WHEN 2 THEN '198.51.100.23' WHEN 3 THEN '103.216.220.' || "
                  "(user_id % 250) WHEN 5 THEN '10.10.31.27' WHEN 6 THEN '10.10.31.44' "
                  "WHEN 7 THEN '203.0.113.77' ELSE '10.20.0.' || (user_id % 200) END"),
    ("destination_domain", "CASE user_id % 11 WHEN 0 THEN 'a.cdn-update-service.net' WHEN 1 THEN "
                           "'notexfil-drop.cloud' WHEN 2 THEN 'exfil-drop.cloud' END"),
    ("process_name", "CASE WHEN user_id % 2 = 0 THEN 'svcmon' || (user_id % 7) || '.exe' END"),
]
_GROUPED = ("SELECT event_type, user_id, CAST(floor({secs} / 86400) AS BIGINT) AS day, "
            "CAST(count(*) AS BIGINT) AS n, min({secs}) AS first_s, max({secs}) AS last_s, "
            "max(CAST(round(value * 100) AS BIGINT) * 10000) AS mx FROM {src} "
            "WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2, 3 HAVING count(*) >= 2")
_ALERTS = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _ALERT) + " FROM ({g}) g"
ALERTS_SQL = "al AS (" + _ALERTS.replace("{g}", _GROUPED.format(src="events", **_DUCK)) + ")"
ENTITY_KINDS = ["user_name", "host_name", "source_ip", "destination_domain", "process_name"]


def day_alerts(spark, sf_dir) -> DataFrame:
    """Alert rows in the engine's alert layout, built from the events table."""
    src = table(spark, sf_dir, "events")
    flat = spark.sql(_ALERTS.replace("{g}", _GROUPED.format(src="{src}", **_SPARK)), src=src)
    entities = F.map_from_entries(F.array_compact(F.array(*[
        F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("key"), F.array(k).alias("value")))
        for k in ENTITY_KINDS])))
    return flat.select(
        "alert_id", "rule_id", F.concat(F.lit("Rule "), "rule_id").alias("rule_name"), "severity",
        "confidence", "risk", "tactic",
        F.array(F.concat(F.lit("T"), F.length("tactic").cast("string")), "rule_id").alias("technique"),
        F.col("n").alias("count"), F.timestamp_seconds("first_s").alias("first_seen"),
        F.timestamp_seconds("last_s").alias("last_seen"), entities.alias("entities"),
        F.concat(F.lit("n="), F.col("n").cast("string")).alias("note"),
        F.lit(1).alias("repeat_count"), "prior_events", F.col("mx").cast("double").alias("max_bytes"),
        F.lit(None).cast("struct<interval_mean_s:double,interval_stdev_s:double,cov:double,"
                         "events_in_window:bigint>").alias("baseline"))
