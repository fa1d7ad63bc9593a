"""Structured Streaming variants: ingest, thresholds and alert dedup."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from secframe.operators.hits import key_by_rule, literal_by_rule, rule_hits
from secframe.operators.threshold import distinct_limits, distinct_value
from secframe.plans.rules import load_rules
from secframe.schema import EVENT_SCHEMA, LOWERCASED
from secframe.sources.registry import parse_lines, write_events
from secframe.streaming.sequences import timed

LOSS = "source string, lines bigint, parsed bigint, parse_errors bigint"


# ---------------------------------------------------------------- ingest
#: bits of a streamed event's number: tasks of a batch, rows of a task; the batch number is above them
_TASK_BITS, _ROW_BITS = 12, 26


def _numbered(batch_id: int) -> Column:
    """Unique numbers that grow from batch to batch; more tasks or rows than fit are an error."""
    at = F.monotonically_increasing_id()
    task, row = F.shiftright(at, 33), at.bitwiseAND(F.lit(2 ** 33 - 1))
    fits = (task < 2 ** _TASK_BITS) & (row < 2 ** _ROW_BITS)
    return F.when(fits, F.lit(batch_id << (_TASK_BITS + _ROW_BITS)) + F.shiftleft(task, _ROW_BITS) + row).otherwise(
        F.raise_error(F.lit("a micro-batch has too many tasks or rows to number its events")).cast("bigint"))


def stream_ingest(lines: DataFrame, spec: dict, source: str, events_path: str, loss_path: str,
                  checkpoint: str, header: str | None = None):
    """Growing log files -> partitioned event table, with per-batch loss counts beside it.

    The normalization is the batch one.  Lines are counted while they are written (observed metrics),
    so they are read and parsed once.  Both writes carry the batch number in their folder and replace
    it, so a batch repeated after a failure leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, seen = batch.sparkSession, Observation(f"loss {source} {batch_id}")
        bad = F.col("_error").isNotNull()
        records = parse_lines(batch, spec, source, header).observe(
            seen, F.count(F.lit(1)).alias("lines"), F.count_if(~bad & ~F.col("_blank")).alias("parsed"), F.count_if(bad).alias("parse_errors"))
        good = records.withColumn("event_seq", _numbered(batch_id)).filter(~bad & ~F.col("_blank"))
        write_events(good.select(*[f.name for f in EVENT_SCHEMA.fields]), f"{events_path}/batch={batch_id}", mode="overwrite")
        n = seen.get
        spark.createDataFrame([(source, n["lines"], n["parsed"], n["parse_errors"])], LOSS).coalesce(1).write.mode("overwrite").parquet(
            f"{loss_path}/batch={batch_id}")
    return (lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


def stream_loss(spark: SparkSession, loss_path: str) -> DataFrame:
    """Lines, parsed records, errors and loss per source over all batches."""
    sums = spark.read.parquet(loss_path).groupBy("source").agg(*[F.sum(c).alias(c) for c in ("lines", "parsed", "parse_errors")])
    return sums.withColumn("loss_pct", F.round(100.0 * F.col("parse_errors") / F.col("lines"), 2))


# ---------------------------------------------------------------- thresholds
def stream_threshold_counts(events: DataFrame, rules, span_minutes: float, delay: str | None = "10 minutes",
                            lowercased=LOWERCASED) -> DataFrame:
    """Counts per (rule, key, tumbling window, distinct value) for the threshold rules of one length.

    Windows are aligned to the epoch.  State is one counter per open group and value of the rule's
    distinct field (null for rules without one); rows later than the watermark are dropped.
    """
    rules = load_rules(rules)
    hits = rule_hits(events, rules, lowercased)
    mine = [i for i, r in enumerate(rules) if r.threshold
            and r.span_micros("threshold") == int(span_minutes * 60_000_000)]
    keyed = hits.filter(F.col("rule_ix").isin(mine) & ~F.col("is_prior")).select(
        "rule_ix", key_by_rule(hits, rules, "threshold").alias("key"),
        distinct_value(hits, rules).alias("value"), F.col("ts"))
    window = F.window("ts", f"{int(span_minutes * 60)} seconds")
    if delay is not None:       # else the events carry a watermark already
        keyed = keyed.withWatermark("ts", delay)
    return (keyed.groupBy("rule_ix", "key", "value", window)
            .agg(F.count(F.lit(1)).alias("observed"))
            .select("rule_ix", "key", "value", "window", F.col("window.start").alias("window_start"), "observed"))


def stream_threshold_windows(events: DataFrame, rules, span_minutes: float, delay: str = "10 minutes",
                             lowercased=LOWERCASED) -> DataFrame:
    """Windows that reach their rule's limits, each emitted once, when the watermark closes it (append mode).

    The watermark follows all events, not only those that match.  Counts per distinct value are
    combined on the map side first; a second step adds them up per window.
    """
    rules = load_rules(rules)
    counts = stream_threshold_counts(timed(events, delay), rules, span_minutes, None, lowercased)
    whole = counts.groupBy("rule_ix", "key", "window").agg(
        F.sum("observed").alias("observed"), F.count("value").alias("distinct_count"))
    return _enough(whole.select("rule_ix", "key", F.col("window.start").alias("window_start"), "observed", "distinct_count"), rules)


def _enough(windows: DataFrame, rules) -> DataFrame:
    least = literal_by_rule([int(r.threshold.get("min_events", 1)) for r in rules], "bigint")
    variety = literal_by_rule(distinct_limits(rules), "bigint")
    return windows.filter((F.col("observed") >= least) & (F.col("distinct_count") >= variety))


def late_rows(query) -> int:
    """Rows a query has dropped so far because the watermark had passed them."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def upsert_counts(path: str):
    """Sink for update mode: every batch writes its changed groups under its own number and their day."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.drop("window").withColumn("day", F.to_date("window_start")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch_id}")
    return write


def current_counts(spark: SparkSession, path: str, rules, since=None) -> DataFrame:
    """Latest counts of every group, kept where events and distinct values reach the rule's limits.

    With ``since`` (a date) only the days from then on are read: windows before it are closed, and
    ``stream_threshold_windows`` has emitted them for good.
    """
    rules = load_rules(rules)
    stored = spark.read.parquet(path)
    if since is not None:
        stored = stored.filter(F.col("day") >= F.lit(since).cast("date"))
    latest = (stored.groupBy("rule_ix", "key", "window_start", "value").agg(F.max_by("observed", "batch").alias("observed"))
              .groupBy("rule_ix", "key", "window_start")
              .agg(F.sum("observed").alias("observed"), F.count("value").alias("distinct_count")))
    return _enough(latest, rules)


# ---------------------------------------------------------------- alerts
def stream_unique_alerts(alerts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per alert id as long as repeats arrive within the watermark."""
    return alerts.withWatermark("last_seen", delay).dropDuplicatesWithinWatermark(["alert_id"])
