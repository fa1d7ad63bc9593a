"""Detection queries: the shipped operators over the events table and its security view."""
from __future__ import annotations

from pyspark.sql import functions as F

from secframe.catalog.base import CAPTURE_SQL, capture, events, query, secs, table
from secframe.functions.values import micros
from secframe.operators.beacon import densest_windows, instants_of, regularity
from secframe.operators.hits import group_key, rule_hits, with_evidence
from secframe.operators.sequence import fired_sequences, preceded, sequence_rows
from secframe.operators.threshold import distinct_sketches, groups_of_sketches, origin_of, threshold_groups, tumbling_buckets
from secframe.operators.travel import consecutive_moves
from secframe.operators.alerts import single_event_alerts
from secframe.plans.detect import detect, detect_with_values, run_summary
from secframe.plans.rulepack import RULES
from secframe.plans.rules import load_rules
from secframe.session import scratch_path

CAP = "WITH " + CAPTURE_SQL
DAY = 1440
US = "epoch_us(ts)"
LOWER = {"event_type"}
FAILED = "event_action = 'failed-logon' AND source_ip NOT LIKE '10.%'"


def pack(*ids):
    return load_rules([r for r in RULES if not ids or r["id"] in ids])


def _errors(**more):
    return {"id": "R-ERR", "name": "Repeated errors", "condition": {"event_type": "error"}, **more}


@query("threshold_errors", f"""
WITH h AS (SELECT user_id, {US} AS t, ({US} - (SELECT min({US}) FROM events)) // 86400000000 AS bucket
  FROM events WHERE event_type = 'error')
SELECT CAST(user_id AS VARCHAR) AS key, bucket, count(*) AS observed,
  CAST(floor(min(t) / 1000000) AS BIGINT) AS first_s, CAST(floor(max(t) / 1000000) AS BIGINT) AS last_s
FROM h GROUP BY 1, 2 HAVING count(*) >= 2""")
def threshold_errors(spark, sf):
    """Tumbling threshold anchored at the earliest event: two errors per user and day."""
    e = events(spark, sf)
    rules = load_rules([_errors(threshold={"field": "user_id", "min_events": 2, "window_minutes": DAY})])
    groups = threshold_groups(tumbling_buckets(rule_hits(e, rules, LOWER), rules, origin_of(e)), rules)
    s = lambda c: F.floor(F.col(c) / 1000000)
    return groups.select("key", "bucket", "observed", s("first_t").alias("first_s"), s("last_t").alias("last_s"))


@query("threshold_fixed_origin", f"""
SELECT CAST(user_id AS VARCHAR) AS key, {US} // 86400000000 AS bucket, count(*) AS observed
FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2""")
def threshold_fixed(spark, sf):
    """The same with windows anchored at a fixed instant, as streams need it (D3)."""
    rules = load_rules([_errors(threshold={"field": "user_id", "min_events": 2, "window_minutes": DAY})])
    hits = rule_hits(events(spark, sf), rules, LOWER)
    return threshold_groups(tumbling_buckets(hits, rules, F.lit(0).cast("bigint")), rules).select(
        "key", "bucket", "observed")


@query("distinct_threshold", f"""
WITH h AS (SELECT user_id, event_type, ({US} - (SELECT min({US}) FROM events)) // 86400000000 AS bucket FROM events)
SELECT CAST(user_id AS VARCHAR) AS key, bucket, count(*) AS observed, count(DISTINCT event_type) AS distinct_count
FROM h GROUP BY 1, 2 HAVING count(*) >= 5 AND count(DISTINCT event_type) >= 4""")
def distinct_threshold(spark, sf):
    """Five events of four kinds per user and day."""
    e = events(spark, sf)
    rules = load_rules([{"id": "R-MIX", "condition": {"event_id": {"exists": True}}, "threshold": {
        "field": ["user_id"], "distinct_field": "event_type", "min_events": 5, "min_distinct": 4,
        "window_minutes": DAY}}])
    return threshold_groups(tumbling_buckets(rule_hits(e, rules, LOWER), rules, origin_of(e)), rules).select(
        "key", "bucket", "observed", "distinct_count")


@query("distinct_threshold_sketches", f"""
WITH h AS (SELECT user_id, event_type, ({US} - (SELECT min({US}) FROM events)) // 86400000000 AS bucket FROM events)
SELECT CAST(user_id AS VARCHAR) AS key, bucket, count(*) AS observed, count(DISTINCT event_type) AS distinct_count
FROM h GROUP BY 1, 2 HAVING count(*) >= 5 AND count(DISTINCT event_type) >= 4""")
def distinct_sketches_query(spark, sf):
    """Distinct values by stored sketches of four slices of the events, merged (D4); exact for so few values."""
    e = events(spark, sf)
    rules = load_rules([{"id": "R-MIX", "condition": {"event_id": {"exists": True}}, "threshold": {
        "field": ["user_id"], "distinct_field": "event_type", "min_events": 5, "min_distinct": 4, "window_minutes": DAY}}])
    rows = tumbling_buckets(rule_hits(e, rules, LOWER), rules, origin_of(e)).withColumn("slice", F.pmod(F.xxhash64("event_id"), F.lit(4)))
    path = scratch_path(spark, "sketches")
    for i in range(4):
        distinct_sketches(rows.filter(F.col("slice") == i)).write.parquet(f"{path}/part={i}")
    return groups_of_sketches(spark.read.parquet(path), rules).select("key", "bucket", "observed", "distinct_count")


def _sequence_rule():
    return load_rules([{"id": "R-SEQ", "condition": {"event_type": "purchase"}, "requires": {
        "condition": {"event_type": "error"}, "min_count": 2, "window_minutes": DAY, "key_fields": ["user_id"]}}])


_SEQ = f"""q AS (SELECT p.user_id AS k, epoch_us(p.ts) AS t, count(*) AS prior_events
  FROM events p JOIN events e ON e.user_id = p.user_id AND e.event_type = 'error'
    AND epoch_us(e.ts) <= epoch_us(p.ts) AND epoch_us(e.ts) >= epoch_us(p.ts) - 86400000000
  WHERE p.event_type = 'purchase' GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query("sequence_prior", "WITH " + _SEQ + " SELECT CAST(k AS VARCHAR) AS key, t, prior_events FROM q")
def sequence_prior(spark, sf):
    """Purchases with at least two errors of the user in the day before."""
    rules = _sequence_rule()
    rows = sequence_rows(rule_hits(events(spark, sf), rules, LOWER), rules)
    return preceded(rows, rules).select("key", "t", "prior_events")


@query("sequence_cooldown", "WITH RECURSIVE " + _SEQ + """,
fired(k, t) AS (SELECT k, min(t) FROM q GROUP BY k
  UNION ALL SELECT f.k, min(q.t) FROM fired f JOIN q ON q.k = f.k AND q.t > f.t + 86400000000 GROUP BY f.k)
SELECT CAST(k AS VARCHAR) AS key, t FROM fired""")
def sequence_cooldown(spark, sf):
    """The same after the per-key cooldown."""
    rules = _sequence_rule()
    return fired_sequences(sequence_rows(rule_hits(events(spark, sf), rules, LOWER), rules), rules).select("key", "t")


@query("threshold_then_sequence", "WITH " + _SEQ + """ SELECT 'R-BOTH-SEQ' AS rule_id, count(DISTINCT k) > 0 AS fired_any FROM q
UNION ALL SELECT 'R-BOTH-TH', count(*) > 0 FROM events WHERE event_type = 'purchase'""")
def threshold_then_sequence(spark, sf):
    """A rule with both reports its sequence only while its threshold stays quiet."""
    both = {"condition": {"event_type": "purchase"}, "requires": {
        "condition": {"event_type": "error"}, "min_count": 2, "window_minutes": DAY, "key_fields": ["user_id"]}}
    rules = [{**both, "id": "R-BOTH-SEQ", "threshold": {"field": "user_id", "min_events": 1000000, "window_minutes": 60}},
             {**both, "id": "R-BOTH-TH", "threshold": {"field": "user_id", "min_events": 1, "window_minutes": 60}}]
    a = detect(events(spark, sf), rules, lowercased=LOWER)
    seq = F.max(F.when(F.col("prior_events").isNotNull(), 1).otherwise(0))
    out = a.groupBy("rule_id").agg(seq.alias("s"))
    wants = F.when(F.col("rule_id") == "R-BOTH-SEQ", 1).otherwise(0)
    return out.select("rule_id", (F.col("s") == wants).alias("fired_any"))


@query("impossible_travel", """
WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS t, -60.0 + 5 * (event_id % 25) AS lat,
   -150.0 + 12 * (event_id % 25) AS lon FROM events WHERE event_type = 'purchase'),
l AS (SELECT *, lag(event_id) OVER w AS a_id, lag(t) OVER w AS a_t, lag(lat) OVER w AS a_lat, lag(lon) OVER w AS a_lon
  FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
d AS (SELECT user_id, a_id, event_id AS b_id, (t - a_t) / 60000000.0 AS minutes,
  2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians(a_lat)) / 2), 2) + cos(radians(a_lat)) * cos(radians(lat))
   * pow(sin((radians(lon) - radians(a_lon)) / 2), 2)))) AS km FROM l WHERE t - a_t > 0 AND t - a_t <= 86400000000)
SELECT user_id, a_id, b_id, CAST(round(km) AS BIGINT) AS km FROM d WHERE km >= 400""")
def impossible_travel(spark, sf):
    """Consecutive far-apart points of a user within a day."""
    p = events(spark, sf).filter(F.col("event_type") == "purchase").select(
        "user_id", "event_seq", micros(F.col("ts")).alias("t"),
        (F.lit(-60.0) + 5 * (F.col("event_id") % 25)).alias("lat"),
        (F.lit(-150.0) + 12 * (F.col("event_id") % 25)).alias("lon"))
    day = DAY * 60_000_000
    moves = consecutive_moves(p, ["user_id"], F.lit(day), day, [])
    return moves.filter("km >= 400").select(
        "user_id", F.col("a.event_seq").alias("a_id"), F.col("b.event_seq").alias("b_id"),
        F.round("km").cast("bigint").alias("km"))


@query("densest_window", """
WITH h AS (SELECT user_id, epoch_us(ts) AS t FROM events),
c AS (SELECT user_id, t, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW) AS n FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, t) AS rn FROM c)
SELECT user_id, t AS window_end, n AS in_window FROM r WHERE rn = 1""")
def densest(spark, sf):
    """Earliest three-day window holding the most events of a user."""
    inst = events(spark, sf).groupBy("user_id", micros(F.col("ts")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    span = 3 * DAY * 60_000_000
    return densest_windows(inst, ["user_id"], F.lit(span).cast("bigint"))


@query("beaconing", """
WITH h AS (SELECT user_id, epoch_us(ts) AS t FROM events),
c AS (SELECT user_id, t, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW) AS n FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, t) AS rn FROM c),
b AS (SELECT user_id, t AS e, n FROM r WHERE rn = 1 AND n >= 8),
g AS (SELECT h.user_id, b.n, (h.t - lag(h.t) OVER (PARTITION BY h.user_id ORDER BY h.t)) / 1e6 AS gap
  FROM h JOIN b ON b.user_id = h.user_id AND h.t BETWEEN b.e - 259200000000 AND b.e),
s AS (SELECT user_id, max(n) AS n, avg(gap) AS m, stddev_pop(gap) AS sd FROM g GROUP BY user_id)
SELECT user_id, n AS in_window, round(m, 2) AS mean_s, round(sd / m, 3) AS cov FROM s WHERE sd / m <= 0.8""")
def beaconing(spark, sf):
    """Regularity of intervals inside the densest window."""
    inst = events(spark, sf).groupBy("user_id", micros(F.col("ts")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    span = 3 * DAY * 60_000_000
    width = F.lit(span).cast("bigint")
    dense = densest_windows(inst, ["user_id"], width).filter("in_window >= 8")
    stats = regularity(inst, dense, ["user_id"], width)
    return stats.filter("cov <= 0.8").select("user_id", "in_window", F.round("mean_s", 2).alias("mean_s"),
                                             F.round("cov", 3).alias("cov"))


@query("beacon_rule", """
WITH h AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'hot' ELSE CAST(user_id AS VARCHAR) END AS k, epoch_us(ts) AS t FROM events),
c AS (SELECT k, t, count(*) OVER (PARTITION BY k ORDER BY t RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW) AS n FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, t) AS rn FROM c),
b AS (SELECT k, t AS e, n FROM r WHERE rn = 1 AND n >= 6),
g AS (SELECT h.k, b.n, h.t, (h.t - lag(h.t) OVER (PARTITION BY h.k ORDER BY h.t)) / 1e6 AS gap FROM h JOIN b ON b.k = h.k AND h.t BETWEEN b.e - 259200000000 AND b.e),
s AS (SELECT k, max(n) AS n, min(t) AS f, max(t) AS l, avg(gap) AS m, stddev_pop(gap) AS sd FROM g GROUP BY k)
SELECT n AS events, n AS in_window, CAST(floor(f / 1000000) AS BIGINT) AS first_s, CAST(floor(l / 1000000) AS BIGINT) AS last_s, round_even(m, 1) AS mean_s, round_even(sd / m, 4) AS cov
FROM s WHERE sd / m <= 1.1 AND m >= 20 AND m <= 100000""")
def beacon_rule(spark, sf):
    """A regularity rule from events to alert rows, one key holding half of all events."""
    e = events(spark, sf).withColumn("k", F.when(F.col("event_id") % 2 == 0, "hot").otherwise(F.col("user_id").cast("string")))
    rule = {"id": "R-BEAT", "condition": {"event_id": {"exists": True}}, "config": {
        "group_by": ["k"], "threshold": {"min_events": 6, "window_minutes": 3 * DAY},
        "time_stats": {"max_cov": 1.1, "min_interval_s": 20, "max_interval_s": 100000}}}
    a = detect(e, [rule], lowercased=LOWER, fold=False)
    return a.select(F.col("count").alias("events"), F.col("baseline.events_in_window").alias("in_window"), secs("first_seen").alias("first_s"),
                    secs("last_seen").alias("last_s"), F.col("baseline.interval_mean_s").alias("mean_s"), F.col("baseline.cov").alias("cov"))


@query("travel_rule", CAP + """, place(p, label, lat, lon) AS (VALUES ('103.216.220.', 'Chennai, IN', 13.0827::DOUBLE, 80.2707::DOUBLE), ('104.28.55.', 'Singapore, SG', 1.3521, 103.8198),
 ('45.155.205.', 'Frankfurt, DE (anonymizer)', 50.1109, 8.6821), ('203.0.113.', 'Johannesburg, ZA', -26.2041, 28.0473), ('198.51.100.', 'Sao Paulo, BR', -23.5505, -46.6333),
 ('192.0.2.', 'Ashburn US (bulletproof hosting)', 39.0438, -77.4874)),
h AS (SELECT coalesce(host_name, '?') AS host, ts_s, event_seq, label, lat, lon FROM cap JOIN place ON starts_with(source_ip, p) WHERE event_action IN ('successful-logon', 'failed-logon')),
l AS (SELECT *, lag(ts_s) OVER w AS a_s, lag(label) OVER w AS a_label, lag(lat) OVER w AS a_lat, lag(lon) OVER w AS a_lon FROM h WINDOW w AS (PARTITION BY host ORDER BY ts_s, event_seq)),
d AS (SELECT *, (ts_s - a_s) / 60.0 AS minutes, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians(a_lat)) / 2), 2) + cos(radians(a_lat)) * cos(radians(lat))
   * pow(sin((radians(lon) - radians(a_lon)) / 2), 2)))) AS km FROM l WHERE ts_s > a_s AND ts_s - a_s <= 3600),
f AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts_s) AS rn FROM d WHERE km >= 400)
SELECT host, a_s AS first_s, ts_s AS last_s, a_label AS came_from, label AS went_to, CAST(round_even(km, 0) AS BIGINT) AS km, CAST(round_even(km / (minutes / 60.0), 0) AS BIGINT) AS kmh FROM f WHERE rn = 1""")
def travel_rule(spark, sf):
    """The shipped travel rule, widened to failed logons of a host: geolocation, first far pair per key, speed."""
    rule = dict(next(r for r in RULES if r["id"] == "SOC-IMPTVL-005"))
    rule["condition"] = [{"event.action": ["successful-logon", "failed-logon"], "source.ip_not_private": True}]
    rule["window"] = {**rule["window"], "group_by": ["host.name"]}
    a = detect(capture(spark, sf), [rule], fold=False)
    return a.select(F.coalesce(F.col("entities")["host_name"][0], F.lit("?")).alias("host"), secs("first_seen").alias("first_s"), secs("last_seen").alias("last_s"),
                    F.col("geo.from").alias("came_from"), F.col("geo.to").alias("went_to"), F.col("geo.distance_km").alias("km"), F.col("geo.required_speed_kmh").alias("kmh"))


@query("null_safe_key", CAP + """ SELECT coalesce(host_name, '?') || '|' || coalesce(process_name, '?') || '|?' AS key,
 count(*) AS n FROM cap GROUP BY 1""")
def null_safe_key(spark, sf):
    """Composite keys: missing parts become '?' (D11)."""
    df = capture(spark, sf)
    return df.groupBy(group_key(df, ["host.name", "process.name", "no.such.field"]).alias("key")).agg(
        F.count(F.lit(1)).alias("n"))


_MULTI_IDS = ["SOC-OWA-006", "SOC-C2-021", "SOC-C2-022", "SOC-EXFIL-025", "SOC-INIT-033", "SOC-SCAN-020"]


@query("multi_rule_hits", CAP + """
SELECT 'SOC-OWA-006' AS rule_id, event_seq FROM cap WHERE event_dataset = 'web' AND url_path LIKE '%auth.owa%' AND http_response_status_code = 401
UNION ALL SELECT 'SOC-C2-021', event_seq FROM cap WHERE event_dataset IN ('web', 'proxy') AND url_path = '/gate.php'
UNION ALL SELECT 'SOC-C2-022', event_seq FROM cap WHERE event_dataset = 'proxy' AND destination_domain = 'cdn-update-service.net'
UNION ALL SELECT 'SOC-EXFIL-025', event_seq FROM cap WHERE event_dataset = 'firewall' AND destination_port = 445 AND destination_ip NOT LIKE '10.%' AND event_action = 'allow'
UNION ALL SELECT 'SOC-INIT-033', event_seq FROM cap WHERE event_dataset = 'web' AND url_path = '/.env'
UNION ALL SELECT 'SOC-SCAN-020', event_seq FROM cap WHERE event_dataset = 'firewall' AND event_action = 'deny' AND destination_port IS NOT NULL AND source_ip <> '203.0.113.77'""")
def multi_rule_hits(spark, sf):
    """Six rules in one scan."""
    rules = pack(*_MULTI_IDS)
    hits = rule_hits(capture(spark, sf), rules)
    ids = F.array(*[F.lit(r.id) for r in rules])
    return hits.select(ids[F.col("rule_ix")].alias("rule_id"), "event_seq")


@query("single_event_alerts", CAP + """, h AS (
 SELECT 'SOC-C2-021' AS rule_id, * FROM cap WHERE event_dataset IN ('web', 'proxy') AND url_path = '/gate.php'
 UNION ALL SELECT 'SOC-EXFIL-025', * FROM cap WHERE event_dataset = 'firewall' AND destination_port = 445 AND destination_ip NOT LIKE '10.%' AND event_action = 'allow')
SELECT rule_id, source_ip, host_name, user_name, count(*) AS hits, min(ts_s) AS first_s, max(ts_s) AS last_s,
 arg_min(coalesce(url_path, ''), ts_s * 1000000 + event_seq) AS text, CAST(max(network_bytes) AS BIGINT) AS max_bytes
FROM h GROUP BY 1, 2, 3, 4""")
def single_alerts(spark, sf):
    """Single-event rules folded per source, host and user."""
    a = detect(capture(spark, sf), pack("SOC-C2-021", "SOC-EXFIL-025"))
    ent = lambda k: F.get(F.col("entities")[k], F.lit(0)).alias(k)
    return a.select("rule_id", ent("source_ip"), ent("host_name"), ent("user_name"), F.col("count").alias("hits"),
                    secs("first_seen").alias("first_s"), secs("last_seen").alias("last_s"),
                    F.col("sample")[0]["text"].alias("text"), F.col("max_bytes").cast("bigint").alias("max_bytes"))


_BRUTE = CAP + f""", h AS (SELECT *, (ts_s - (SELECT min(ts_s) FROM cap)) // 900 AS bucket FROM cap WHERE {FAILED}),
g AS (SELECT source_ip, bucket, count(*) AS n FROM h GROUP BY 1, 2 HAVING count(*) >= 6),
m AS (SELECT h.* FROM h JOIN g USING (source_ip, bucket))"""


def _spray(spark, sf):
    rule = dict(next(r for r in RULES if r["id"] == "SOC-CSTUF-004"))
    rule["threshold"] = {**rule["threshold"], "min_distinct": 1}
    return detect(capture(spark, sf), [rule], fold=False)


@query("alert_rows", _BRUTE + """ SELECT source_ip, count(*) AS n, min(ts_s) AS first_s, max(ts_s) AS last_s,
 max(ts_s) - min(ts_s) AS window_seconds, count(DISTINCT user_name) AS distinct_count,
 count(DISTINCT user_name) || ' distinct user.name values in 15m' AS note, 'SOC-CSTUF-004' AS rule_id,
 'medium' AS severity, CAST(50 AS INT) AS risk FROM m GROUP BY source_ip, bucket""")
def alert_rows(spark, sf):
    """Alert rows with counts, times and rule metadata."""
    return _spray(spark, sf).select(
        F.col("entities")["source_ip"][0].alias("source_ip"), F.col("count").alias("n"),
        secs("first_seen").alias("first_s"), secs("last_seen").alias("last_s"), "window_seconds",
        "distinct_count", "note", "rule_id", "severity", "risk")


@query("alert_entities", _BRUTE + """, f AS (
 SELECT source_ip, bucket, 'user_name' AS field, user_name AS value, min(ts_s * 1000000 + event_seq) AS o FROM m GROUP BY ALL
 UNION ALL SELECT source_ip, bucket, 'host_name', host_name, min(ts_s * 1000000 + event_seq) FROM m WHERE host_name IS NOT NULL GROUP BY ALL
 UNION ALL SELECT source_ip, bucket, 'network_bytes', CAST(network_bytes AS VARCHAR), min(ts_s * 1000000 + event_seq) FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_ip, bucket, field ORDER BY o, value) AS rn FROM f),
first AS (SELECT source_ip, bucket, min(ts_s) AS first_s FROM m GROUP BY ALL)
SELECT r.source_ip, first.first_s, field, rn - 1 AS pos, value FROM r JOIN first USING (source_ip, bucket) WHERE rn <= 12""")
def alert_entities(spark, sf):
    """First dozen distinct values per entity in event order."""
    a = _spray(spark, sf)
    ent = a.select(F.col("entities")["source_ip"][0].alias("source_ip"), secs("first_seen").alias("first_s"),
                   F.explode("entities").alias("field", "values"))
    return (ent.filter(F.col("field") != "source_ip")
            .select("source_ip", "first_s", "field", F.posexplode("values").alias("pos", "value"))
            .withColumn("pos", F.col("pos").cast("bigint")))


@query("alert_values", _BRUTE + """, f AS (
 SELECT source_ip, bucket, 'user_name' AS kind, user_name AS value FROM m UNION ALL SELECT source_ip, bucket, 'host_name', host_name FROM m WHERE host_name IS NOT NULL
 UNION ALL SELECT source_ip, bucket, 'network_bytes', CAST(network_bytes AS VARCHAR) FROM m UNION ALL SELECT source_ip, bucket, 'source_ip', source_ip FROM m),
first AS (SELECT source_ip, bucket, min(ts_s) AS first_s FROM m GROUP BY ALL)
SELECT f.source_ip, first.first_s, kind, count(DISTINCT value) AS n, min(value) AS lo, max(value) AS hi FROM f JOIN first USING (source_ip, bucket) GROUP BY 1, 2, 3""")
def alert_values(spark, sf):
    """All entity values of alerts, beyond the dozen their rows show."""
    rule = dict(next(r for r in RULES if r["id"] == "SOC-CSTUF-004"))
    rule["threshold"] = {**rule["threshold"], "min_distinct": 1}
    a, values = detect_with_values(capture(spark, sf), [rule], fold=False)
    head = a.select("alert_id", F.col("entities")["source_ip"][0].alias("source_ip"), secs("first_seen").alias("first_s"))
    flat = values.groupBy("alert_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return head.join(flat, "alert_id").drop("alert_id")


@query("alert_distinct", _BRUTE + """, d AS (SELECT source_ip, bucket, user_name, min(ts_s) AS f FROM m GROUP BY ALL),
r AS (SELECT source_ip, bucket, user_name, row_number() OVER (PARTITION BY source_ip, bucket ORDER BY user_name) AS rn,
 count(*) OVER (PARTITION BY source_ip, bucket) AS total, min(f) OVER (PARTITION BY source_ip, bucket) AS first_s FROM d)
SELECT source_ip, first_s, string_agg(user_name, ',' ORDER BY rn) AS users FROM r WHERE rn <= 25 AND total > 1 GROUP BY 1, 2""")
def alert_distinct(spark, sf):
    """Sorted distinct values, 25 kept, only where there are several."""
    return (_spray(spark, sf).filter(F.col("distinct")["user_name"].isNotNull())
            .select(F.col("entities")["source_ip"][0].alias("source_ip"), secs("first_seen").alias("first_s"),
                    F.array_join(F.col("distinct")["user_name"], ",").alias("users")))


@query("alert_samples", _BRUTE + """, r AS (SELECT *, row_number() OVER (PARTITION BY source_ip, bucket ORDER BY ts_s, event_seq) AS rn,
 min(ts_s) OVER (PARTITION BY source_ip, bucket) AS first_s FROM m)
SELECT source_ip, first_s, rn - 1 AS pos, ts_s, event_action AS action FROM r WHERE rn <= 6""")
def alert_samples(spark, sf):
    """First six events of each alert."""
    return (_spray(spark, sf).select(F.col("entities")["source_ip"][0].alias("source_ip"),
                                     secs("first_seen").alias("first_s"), F.posexplode("sample").alias("pos", "s"))
            .select("source_ip", "first_s", F.col("pos").cast("bigint").alias("pos"), secs("s.ts").alias("ts_s"),
                    "s.action"))


@query("alert_fold", CAP + """, h AS (SELECT *, (ts_s - (SELECT min(ts_s) FROM cap)) // 900 AS bucket FROM cap
  WHERE event_dataset = 'firewall' AND network_bytes >= 100000000 AND user_id % 10 IN (0, 1, 2)),
g AS (SELECT source_ip, host_name, user_name, bucket, count(*) AS n, min(ts_s) AS f, max(ts_s) AS l FROM h GROUP BY 1, 2, 3, 4)
SELECT source_ip, host_name, user_name, CAST(sum(n) AS BIGINT) AS n, min(f) AS first_s, max(l) AS last_s, count(*) AS repeats
FROM g GROUP BY 1, 2, 3""")
def alert_fold(spark, sf):
    """Alerts of one rule on the same source, host and user fold into the first."""
    rule = {"id": "R-FOLD", "logsource": {"dataset": ["firewall"]},
            "condition": {"network.bytes": {"gte": 100000000}, "source.ip": {"cidr": [
                "203.0.113.44/32", "45.155.205.0/24", "198.51.100.0/24"]}},
            "threshold": {"field": ["source.ip", "host.name", "user.name"], "min_events": 1, "window_minutes": 15}}
    a = detect(capture(spark, sf), [rule])
    ent = lambda k: F.get(F.col("entities")[k], F.lit(0)).alias(k)
    return a.select(ent("source_ip"), ent("host_name"), ent("user_name"), F.col("count").alias("n"),
                    secs("first_seen").alias("first_s"), secs("last_seen").alias("last_s"),
                    F.col("repeat_count").cast("bigint").alias("repeats"))


@query("rule_pack_brute_force", CAP + f""", h AS (SELECT *, (ts_s - (SELECT min(ts_s) FROM cap)) // 900 AS bucket FROM cap WHERE {FAILED})
SELECT source_ip, bucket, count(*) AS observed FROM h GROUP BY 1, 2 HAVING count(*) >= 10""")
def brute_force(spark, sf):
    """The shipped brute-force rule with its limit lowered to ten (D3)."""
    rule = dict(next(r for r in RULES if r["id"] == "SOC-BRUTE-001"))
    rule["threshold"] = {**rule["threshold"], "min_events": 10}
    df, rules = capture(spark, sf), load_rules([rule])
    return threshold_groups(tumbling_buckets(rule_hits(df, rules), rules, origin_of(df)), rules).select(
        F.col("key").alias("source_ip"), "bucket", "observed")


@query("rule_pack_logon_after_brute_force", CAP + """, f AS (SELECT source_ip, ts_s FROM cap WHERE event_action = 'failed-logon' AND source_ip NOT LIKE '10.%'),
s AS (SELECT DISTINCT source_ip, ts_s FROM cap WHERE event_action = 'successful-logon' AND source_ip NOT LIKE '10.%')
SELECT s.source_ip, s.ts_s, count(*) AS prior_events FROM s JOIN f ON f.source_ip = s.source_ip AND f.ts_s BETWEEN s.ts_s - 1800 AND s.ts_s
GROUP BY 1, 2 HAVING count(*) >= 10""")
def logon_after_brute_force(spark, sf):
    """The shipped logon-after-failures rule before cooldown."""
    rules = pack("SOC-LOGIN-003")
    rows = sequence_rows(rule_hits(capture(spark, sf), rules), rules)
    return preceded(rows, rules).select(F.col("key").alias("source_ip"),
                                        F.floor(F.col("t") / 1000000).alias("ts_s"), "prior_events")


@query("run_summary", CAP + """ SELECT count(DISTINCT source_ip || coalesce(host_name, '?') || user_name) AS alerts,
 CAST(1 AS BIGINT) AS rules_fired, (SELECT count(*) FROM cap) AS events_scanned, CAST(1 AS BIGINT) AS rules_total
FROM cap WHERE event_dataset = 'web' AND url_path = '/.env'""")
def summary(spark, sf):
    """Run summary."""
    df, rules = capture(spark, sf), pack("SOC-INIT-033")
    return run_summary(df, detect(df, rules), rules)


@query("full_rule_pack")
def full_rule_pack(spark, sf):
    """All shipped rules over the security view: every mode in one run."""
    a = detect(capture(spark, sf), RULES)
    return a.groupBy("rule_id", "severity", "tactic").agg(
        F.count(F.lit(1)).alias("alerts"), F.sum("count").alias("events"),
        secs(F.min("first_seen")).alias("first_s"), secs(F.max("last_seen")).alias("last_s"))
