"""Streaming queries: the events table replayed as a file stream until it is used up."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from secframe.catalog.base import day_alerts, query, secs, table
from secframe.catalog.detections import DAY, LOWER, _SEQ, _sequence_rule
from secframe.catalog.incidents import MINUTES, _INC, scored
from secframe.catalog.ingest import apache_lines
from secframe.functions.values import micros
from secframe.plans.rules import load_rules
from secframe.session import scratch_path
from secframe.sources.registry import SOURCES
from secframe.streaming import sequences as Q, streams as S
from secframe.streaming.cases import latest_incidents, refresh_incidents


def replay(spark, sf) -> DataFrame:
    """The events table as a stream."""
    schema = table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("event_seq", F.col("event_id"))


def as_files(spark, df: DataFrame, files: int = 20, late_share: int = 4, late_days: float = 2.0, key: str = "event_id", time: str = "ts", ahead: dict | None = None):
    """(schema, path of files that arrive one after the other, with rows that come days late).

    Rows are cut into files by time; every ``late_share``-th is moved back by up to ``late_days``, so
    it arrives in a later file than its neighbours.  ``ahead`` gives one more row in a last file, ten
    days after the end: it moves the watermark past everything else.
    """
    path = scratch_path(spark, "arrivals")
    seconds = F.unix_seconds(time)
    lo, hi = df.agg(F.min(seconds), F.max(seconds)).first()
    late = F.when(F.pmod(F.xxhash64(key), F.lit(late_share)) == 0,
                  F.pmod(F.xxhash64(key, F.lit(1)), F.lit(int(late_days * 86_400)))).otherwise(0)
    place = F.least(F.lit(files - 1), F.floor((seconds + late - lo) * files / (hi - lo + 1))).cast("int")
    df.withColumn("part", place).repartition(files, "part").write.partitionBy("part").parquet(path)
    if ahead is not None:
        row = {**ahead, time: F.timestamp_seconds(F.lit(hi + 10 * 86_400))}
        spark.range(1).select(*[row.get(c, F.lit(None)).cast(t).alias(c) for c, t in df.dtypes]).coalesce(1).write.parquet(f"{path}/part={files}")
    # the file source reads files in the order of their times
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith("part="):
            for f in fs.listStatus(folder.getPath()):
                fs.setTimes(f.getPath(), 1_700_000_000_000 + 1000 * int(name[5:]), -1)
    return df.schema, f"{path}/part=*"


def arrivals(spark, sf, per_batch: int = 4, tick: bool = True) -> DataFrame:
    """The events table as twenty files with late rows; no rule wants the last event, a ``tick``."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    schema, path = as_files(spark, e, ahead={"event_id": F.lit(-1), "event_type": F.lit("tick")} if tick else None)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    return s.withColumn("event_seq", F.col("event_id"))


def drain(writer):
    """Run a stream over everything available, then stop."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


@query("stream_threshold", """SELECT CAST(user_id AS VARCHAR) AS key, (epoch_us(ts) // 86400000000) * 86400 AS window_s, count(*) AS observed
FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2""")
def stream_threshold(spark, sf):
    """Tumbling threshold on the stream."""
    rules = load_rules([{"id": "R-ERR", "condition": {"event_type": "error"},
                         "threshold": {"field": "user_id", "min_events": 2, "window_minutes": DAY}}])
    out = scratch_path(spark, "stream-counts")
    counts = S.stream_threshold_counts(replay(spark, sf), rules, DAY, "40 days", LOWER)
    drain(counts.writeStream.outputMode("update").foreachBatch(S.upsert_counts(out))
          .option("checkpointLocation", scratch_path(spark, "ck")))
    return S.current_counts(spark, out, rules).select("key", secs("window_start").alias("window_s"), "observed")


@query("stream_threshold_closed", """SELECT CAST(user_id AS VARCHAR) AS key, (epoch_us(ts) // 86400000000) * 86400 AS window_s, count(*) AS observed,
 count(DISTINCT event_type) AS distinct_count FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT event_type) >= 2""")
def stream_threshold_closed(spark, sf):
    """Windows emitted once the watermark closes them, from files with late rows."""
    rules = load_rules([{"id": "R-MIX", "condition": {"event_type": ["error", "purchase"]},
                         "threshold": {"field": "user_id", "min_events": 2, "window_minutes": DAY, "distinct_field": "event_type", "min_distinct": 2}}])
    out = scratch_path(spark, "stream-windows")
    windows = S.stream_threshold_windows(arrivals(spark, sf), rules, DAY, "3 days", LOWER)
    drain(windows.writeStream.outputMode("append").format("parquet").option("path", out)
          .option("checkpointLocation", scratch_path(spark, "ck")))
    return spark.read.schema(windows.schema).parquet(out).select("key", secs("window_start").alias("window_s"), "observed", "distinct_count")


@query("stream_sequence", "WITH RECURSIVE " + _SEQ + """,
fired(k, t) AS (SELECT k, min(t) FROM q GROUP BY k
  UNION ALL SELECT f.k, min(q.t) FROM fired f JOIN q ON q.k = f.k AND q.t > f.t + 86400000000 GROUP BY f.k)
SELECT CAST(fired.k AS VARCHAR) AS key, fired.t, q.prior_events FROM fired JOIN q ON q.k = fired.k AND q.t = fired.t""")
def stream_sequence(spark, sf):
    """Sequence and cooldown on files that arrive with late rows equal the batch result (S3)."""
    Q.use_state_store(spark)
    out = scratch_path(spark, "stream-sequence")
    fired = Q.stream_sequences(arrivals(spark, sf), _sequence_rule(), LOWER, "3 days")
    drain(fired.writeStream.outputMode("append").format("parquet").option("path", out)
          .option("checkpointLocation", scratch_path(spark, "ck")))
    return spark.read.schema(Q.FIRED).parquet(out).select("key", "t", "prior_events")


@query("stream_ingest", """SELECT 'web' AS source, count(*) AS lines, count(*) FILTER (event_id % 40 <> 0) AS parsed,
 count(*) FILTER (event_id % 40 = 0) AS parse_errors, CAST(sum(CASE WHEN event_id % 40 <> 0 AND event_id % 5 <> 0 THEN event_id ELSE 0 END) AS BIGINT) AS bytes FROM events""")
def stream_ingest(spark, sf):
    """Continuous ingest of rendered access-log lines with loss counts."""
    base = scratch_path(spark, "stream-ingest")
    drain(S.stream_ingest(apache_lines(arrivals(spark, sf, 3, tick=False)), SOURCES["web"], "web", f"{base}/events",
                          f"{base}/loss", f"{base}/ck"))
    loss = S.stream_loss(spark, f"{base}/loss").drop("loss_pct")
    stored = spark.read.parquet(f"{base}/events").agg(F.sum("network_bytes")).scalar()
    return loss.select("*", stored.alias("bytes"))


@query("stream_alert_dedup", """SELECT event_type, count(DISTINCT user_id) AS alerts FROM events
WHERE event_type IN ('error', 'purchase') GROUP BY 1""")
def stream_alert_dedup(spark, sf):
    """Repeated alerts on the stream are dropped within the watermark."""
    e = replay(spark, sf).filter(F.col("event_type").isin("error", "purchase")).select(
        F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("alert_id"), "event_type",
        F.col("ts").alias("last_seen"))
    out = scratch_path(spark, "stream-dedup")
    drain(S.stream_unique_alerts(e, "40 days").writeStream.format("parquet").option("path", out)
          .option("checkpointLocation", scratch_path(spark, "ck")))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("alerts"))


_INC_TIME = _INC + """ SELECT component, severity, score, opened_s, last_s, alert_count, rule_count FROM inc"""


@query("stream_incidents", _INC_TIME)
def stream_incidents(spark, sf):
    """Incidents updated over batches of alerts, some of them days late, equal one run over all."""
    alerts = scored(spark, sf)
    schema, path = as_files(spark, alerts, 5, key="alert_id", time="last_seen")
    base = scratch_path(spark, "stream-incidents")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    drain(stream.writeStream.foreachBatch(refresh_incidents(f"{base}/state", f"{base}/incidents", MINUTES, dedup=False))
          .option("checkpointLocation", f"{base}/ck"))
    inc = latest_incidents(spark, f"{base}/incidents")
    return inc.select("component", "severity", F.col("score").cast("bigint").alias("score"), secs("opened_at").alias("opened_s"),
                      secs("last_activity").alias("last_s"), "alert_count", "rule_count")
