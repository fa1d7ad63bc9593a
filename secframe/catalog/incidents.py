"""Correlation, incident, response and view queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from secframe.catalog.alerts import SCORED_SQL
from secframe.catalog.base import (ALERTS_SQL, CAPTURE_SQL, capture, day_alerts, events, query, secs,
                                   table)
from secframe.catalog.detections import pack
from secframe.operators.components import connected_components
from secframe.operators.correlate import HOUR, correlate, incidents, link_alerts, merged_values
from secframe.operators.enrich import enrich, match_domains, match_ips
from secframe.operators.hits import rule_hits
from secframe.operators.skew import previous_in_order
from secframe.operators.respond import contain, response_plan
from secframe.functions.values import floor_div, micros
from secframe.operators import views as V
from secframe.plans import settings as cfg
from secframe.plans.rulepack import RULES
from secframe.plans.rules import load_rules, rules_frame
from secframe.session import materialize

MINUTES = 1440      # events are sparse: one day links far more alerts than the default 90 minutes
WINDOW = MINUTES * 60


def scored(spark, sf):
    return materialize(enrich(day_alerts(spark, sf)), "scored")


_ENT = """ent AS (SELECT alert_id, score, first_s, last_s, 'user_name' AS kind, user_name AS value FROM sc
 UNION ALL SELECT alert_id, score, first_s, last_s, 'host_name', coalesce(host_name, CASE source_ip WHEN '10.10.31.27' THEN 'WS-FINANCE-07'
   WHEN '10.10.31.44' THEN 'WS-HR-03' END) FROM sc
 UNION ALL SELECT alert_id, score, first_s, last_s, 'source_ip', source_ip FROM sc WHERE source_ip NOT LIKE '10.%'
 UNION ALL SELECT alert_id, score, first_s, last_s, 'destination_domain', destination_domain FROM sc
 UNION ALL SELECT alert_id, score, first_s, last_s, 'process_name', process_name FROM sc),
e2 AS (SELECT * FROM ent WHERE value IS NOT NULL)"""


def _edges_sql(order):
    return SCORED_SQL + ", " + _ENT + f""",
lagged AS (SELECT *, lag(alert_id) OVER w AS p_id, lag(last_s) OVER w AS p_last FROM e2 WINDOW w AS (PARTITION BY kind, value ORDER BY {order})),
near AS (SELECT * FROM lagged WHERE p_id IS NOT NULL AND abs(last_s - p_last) <= {WINDOW}),
shared AS (SELECT near.alert_id, near.p_id, near.kind, near.value, count(DISTINCT x.kind) AS kinds FROM near
  JOIN e2 x ON x.alert_id = near.alert_id JOIN e2 y ON y.alert_id = near.p_id AND y.kind = x.kind AND y.value = x.value GROUP BY 1, 2, 3, 4),
edges AS (SELECT least(alert_id, p_id) AS a, greatest(alert_id, p_id) AS b, kind, value FROM shared
  WHERE kind IN ('user_name', 'host_name') OR kinds >= 2)"""


_COMP = """, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (SELECT alert_id, alert_id FROM sc UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.other),
comp AS (SELECT node AS alert_id, min(other) AS component FROM reach GROUP BY node)"""
_BY_SCORE = _edges_sql("score DESC, first_s, alert_id")
_BY_TIME = _edges_sql("last_s, alert_id")


@query("alert_edges", "WITH " + _BY_SCORE + " SELECT a, b, kind, value FROM edges")
def edges(spark, sf):
    """Neighbours in score order sharing an entity; weak entities need two kinds."""
    return link_alerts(scored(spark, sf), MINUTES)


@query("alert_edges_by_time", "WITH " + _BY_TIME + " SELECT a, b, kind, value FROM edges")
def edges_time(spark, sf):
    """The same with neighbours taken by last activity."""
    return link_alerts(scored(spark, sf), MINUTES, "time")


@query("alert_components", "WITH RECURSIVE " + _BY_TIME + _COMP + " SELECT alert_id, component FROM comp")
def components(spark, sf):
    """Alerts grouped into connected components (C4)."""
    return correlate(scored(spark, sf), MINUTES, "time")


_WIDE = """wide AS (SELECT event_type || '-' || (epoch_us(ts) // 21600000000) AS alert_id, CAST(count(*) % 100 AS INT) AS score, CAST(min(epoch_us(ts)) // 1000000 AS BIGINT) AS first_s,
  CAST(max(epoch_us(ts)) AS BIGINT) AS last_us FROM events GROUP BY event_type, epoch_us(ts) // 21600000000),
vals AS (SELECT DISTINCT event_type || '-' || (epoch_us(ts) // 21600000000) AS alert_id, x.kind, x.value FROM events, LATERAL (VALUES
  ('user_name', CASE WHEN user_id % 3 = 0 THEN 'u' || user_id END), ('process_name', 'p' || (event_id % 211)), ('source_ip', CASE WHEN event_id % 5 = 0 THEN '192.0.2.99'
   ELSE '198.51.100.' || (user_id % 200) END), ('destination_domain', CASE WHEN event_id % 7 = 0 THEN 'h' || (event_id % 50) || '.exfil-drop.cloud' END)) x(kind, value) WHERE x.value IS NOT NULL)"""


def wide_alerts(spark, sf):
    """(alerts of six hours and their long value table): up to hundreds of values per alert."""
    e = events(spark, sf).withColumn("alert_id", F.concat_ws("-", "event_type", floor_div(micros(F.col("ts")), 21_600_000_000).cast("string")))
    n = F.col("user_id"), F.col("event_id")
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    kinds = {"user_name": F.when(n[0] % 3 == 0, text("u", n[0])), "process_name": text("p", n[1] % 211),
             "source_ip": F.when(n[1] % 5 == 0, "192.0.2.99").otherwise(text("198.51.100.", n[0] % 200)),
             "destination_domain": F.when(n[1] % 7 == 0, F.concat(text("h", n[1] % 50), F.lit(".exfil-drop.cloud")))}
    flat = e.select("alert_id", "event_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("x"))
    values = flat.filter("x.value IS NOT NULL").groupBy("alert_id", F.col("x.kind").alias("kind"), F.col("x.value").alias("value")).agg(
        F.struct(F.lit(0).alias("place"), F.min("event_id").alias("t"), F.lit(0).cast("bigint").alias("event_seq")).alias("pos"))
    alerts = e.groupBy("alert_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), (F.count(F.lit(1)) % 100).cast("int").alias("score"))
    return materialize(alerts, "wide-alerts"), materialize(values, "wide-values")


@query("wide_alert_edges", "WITH " + _WIDE + f""", e2 AS (SELECT * FROM vals JOIN wide USING (alert_id)),
lagged AS (SELECT *, lag(alert_id) OVER w AS p_id, lag(last_us) OVER w AS p_last FROM e2 WINDOW w AS (PARTITION BY kind, value ORDER BY last_us, alert_id)),
near AS (SELECT * FROM lagged WHERE p_id IS NOT NULL AND last_us - p_last <= {WINDOW}000000),
pairs AS (SELECT DISTINCT alert_id, p_id FROM near),
shared AS (SELECT pairs.alert_id, pairs.p_id, count(DISTINCT x.kind) AS kinds FROM pairs JOIN vals x ON x.alert_id = pairs.alert_id
  JOIN vals y ON y.alert_id = pairs.p_id AND y.kind = x.kind AND y.value = x.value GROUP BY 1, 2)
SELECT least(n.alert_id, n.p_id) AS a, greatest(n.alert_id, n.p_id) AS b, kind, value FROM near n JOIN shared USING (alert_id, p_id) WHERE kind = 'user_name' OR kinds >= 2""")
def wide_edges(spark, sf):
    """Links over all entity values of alerts that have hundreds."""
    a, values = wide_alerts(spark, sf)
    return link_alerts(a, MINUTES, "time", values)


@query("wide_alert_intel", "WITH " + _WIDE + """, h AS (SELECT alert_id, CASE WHEN value = '192.0.2.99' THEN 94 WHEN value = '198.51.100.23' THEN 71 WHEN value LIKE '%.exfil-drop.cloud' THEN 84 END AS c FROM vals)
SELECT alert_id, count(c) AS hits, CAST(max(c) AS INT) AS confidence FROM h GROUP BY 1""")
def wide_intel(spark, sf):
    """Feed hits over all entity values of an alert, whatever its row shows."""
    a, values = wide_alerts(spark, sf)
    found = match_ips(values, cfg.intel_ip(spark), cfg.geo_prefixes(spark)).unionByName(match_domains(values, cfg.intel_domain(spark)))
    hits = found.groupBy("alert_id").agg(F.count(F.lit(1)).alias("hits"), F.max("confidence").alias("confidence"))
    return a.join(hits, "alert_id", "left").select("alert_id", F.coalesce("hits", F.lit(0)).alias("hits"), "confidence")


@query("wide_incident_entities", "WITH RECURSIVE " + _WIDE + f""", e2 AS (SELECT * FROM vals JOIN wide USING (alert_id) WHERE kind = 'destination_domain'),
lagged AS (SELECT *, lag(alert_id) OVER w AS p_id, lag(last_us) OVER w AS p_last FROM e2 WINDOW w AS (PARTITION BY kind, value ORDER BY last_us, alert_id)),
e AS (SELECT DISTINCT alert_id AS a, p_id AS b FROM lagged WHERE p_id IS NOT NULL AND last_us - p_last <= 3600000000), w2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(n, o) AS (SELECT alert_id, alert_id FROM wide UNION SELECT r.n, w2.b FROM reach r JOIN w2 ON w2.a = r.o),
comp AS (SELECT n AS alert_id, min(o) AS component FROM reach GROUP BY n)
SELECT component, kind, count(DISTINCT value) AS n FROM comp JOIN vals USING (alert_id) GROUP BY 1, 2""")
def wide_entities(spark, sf):
    """All entity values of groups of alerts, counted from the long table."""
    a, values = wide_alerts(spark, sf)
    # one weak kind alone links nothing, so this query names it a strong one
    links = link_alerts(a, 60, "time", values.filter("kind = 'destination_domain'").withColumn("kind", F.lit("host_name")))
    comp = connected_components(links.select("a", "b"), a.select(F.col("alert_id").alias("node"))).select(F.col("node").alias("alert_id"), "component")
    return merged_values(a.join(comp, "alert_id"), "component", values).groupBy("component", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("event_components", """WITH RECURSIVE pairs AS (SELECT user_id, lead(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS nxt,
   event_id FROM events), e AS (SELECT DISTINCT user_id AS a, nxt AS b FROM pairs WHERE nxt IS NOT NULL AND (user_id + nxt) % 41 = 0),
w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(n, o) AS (SELECT DISTINCT user_id, user_id FROM events UNION SELECT r.n, w.b FROM reach r JOIN w ON w.a = r.o)
SELECT n AS node, min(o) AS component FROM reach GROUP BY n""")
def event_components(spark, sf):
    """Components of a graph of users met one after the other (C4)."""
    e = events(spark, sf).withColumn("hour", floor_div(micros(F.col("ts")), HOUR))
    met = previous_in_order(e, ["event_type"], [("hour", False)], [F.col("event_id")], F.col("user_id"), "b")
    pairs = met.select(F.col("user_id").alias("a"), "b").filter("b IS NOT NULL AND (a + b) % 41 = 0")
    return connected_components(pairs, e.select(F.col("user_id").alias("node")))


def _incidents(spark, sf):
    a = scored(spark, sf)
    inc, members = incidents(a, MINUTES, "time", run_ts="2024-01-31 00:00:00")
    return a, materialize(inc, "incidents"), members


_INC = "WITH RECURSIVE " + _BY_TIME + _COMP + """, m AS (SELECT sc.*, comp.component FROM sc JOIN comp USING (alert_id)),
sev(severity, r, h) AS (VALUES ('critical', 0, 1), ('high', 1, 4), ('medium', 2, 8), ('low', 3, 24), ('informational', 4, 72)),
inc AS (SELECT component, arg_min(m.severity, r) AS severity, max(score) AS score, min(first_s) AS opened_s, max(last_s) AS last_s,
  count(*) AS alert_count, count(DISTINCT rule_id) AS rule_count, min(first_s) + 3600 * arg_min(h, r) AS sla_s FROM m JOIN sev USING (severity) GROUP BY 1)"""


@query("incident_rows", _INC + """ SELECT component, severity, score, opened_s, last_s, alert_count, rule_count, sla_s,
  CASE WHEN score >= 75 THEN 'P1' WHEN score >= 55 THEN 'P2' WHEN score >= 35 THEN 'P3' ELSE 'P4' END AS priority,
  row_number() OVER (ORDER BY score DESC, opened_s, component) AS rank,
  greatest(0, alert_count - 14) AS further FROM inc""")
def incident_rows(spark, sf):
    """Incident aggregates, priority, deadline and rank."""
    _, inc, _ = _incidents(spark, sf)
    return inc.select("component", "severity", F.col("score").cast("bigint").alias("score"),
                      secs("opened_at").alias("opened_s"), secs("last_activity").alias("last_s"), "alert_count",
                      "rule_count", secs("sla_due").alias("sla_s"), F.col("recommended_priority").alias("priority"),
                      F.col("rank").cast("bigint").alias("rank"), F.col("further").cast("bigint").alias("further"))


@query("incident_chain", _INC + """, t(tactic, r) AS (VALUES ('reconnaissance', 0), ('initial-access', 1), ('credential-access', 6), ('discovery', 7), ('lateral-movement', 8),
 ('collection', 9), ('exfiltration', 11)),
d AS (SELECT DISTINCT component, tactic, r FROM m JOIN t USING (tactic))
SELECT component, string_agg(tactic, ' -> ' ORDER BY r) AS chain FROM d GROUP BY 1""")
def incident_chain(spark, sf):
    """Tactics of each incident in kill-chain order."""
    _, inc, _ = _incidents(spark, sf)
    return inc.select("component", "chain")


@query("incident_entities", _INC + """, v AS (SELECT component, e2.kind, e2.value, min(e2.first_s) AS f, min_by(e2.alert_id, (e2.first_s, e2.alert_id)) AS aid
   FROM e2 JOIN comp USING (alert_id) GROUP BY ALL
 UNION ALL SELECT component, 'source_ip', source_ip, min(first_s), min_by(alert_id, (first_s, alert_id)) FROM m WHERE source_ip LIKE '10.%' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY component, kind ORDER BY f, aid, value) AS rn FROM v)
SELECT component, kind, rn - 1 AS pos, value FROM r WHERE rn <= 12""")
def incident_entities(spark, sf):
    """Union of entity values per incident, earliest first, a dozen kept."""
    _, inc, _ = _incidents(spark, sf)
    return (inc.select("component", F.explode("entities").alias("kind", "values"))
            .select("component", "kind", F.posexplode("values").alias("pos", "value"))
            .withColumn("pos", F.col("pos").cast("bigint")))


_TRIG = _INC + """, trig AS (SELECT * FROM m WHERE severity = 'critical' OR (severity = 'high' AND confidence IN ('high', 'medium')) OR score >= 80),
pb(tactic, action, step) AS (VALUES ('credential-access', 'block_ip_at_waf', 0), ('credential-access', 'disable_account', 1), ('credential-access', 'force_password_reset', 2),
 ('exfiltration', 'isolate_host', 100), ('exfiltration', 'kill_process_tree', 101), ('exfiltration', 'quarantine_file', 102),
 ('lateral-movement', 'revoke_sessions', 200), ('lateral-movement', 'force_password_reset', 201), ('lateral-movement', 'require_mfa_reenrollment', 202),
 ('credential-access', 'revoke_sessions', 200), ('credential-access', 'require_mfa_reenrollment', 202), ('discovery', 'create_ticket', 300)),
act AS (SELECT component, action, min(step) AS step FROM trig JOIN pb USING (tactic) GROUP BY 1, 2),
why AS (SELECT component, array_to_string(list_sort(list(DISTINCT tactic)), ' + ') || ' -> ' || array_to_string(list_sort(list(DISTINCT rule_id)), ', ') AS justification FROM trig GROUP BY 1)"""


@query("response_plan", _TRIG + """ SELECT component, action, CAST(step AS BIGINT) AS step, justification FROM act JOIN why USING (component)
UNION ALL SELECT component, 'none', -1, 'no alert met the policy bar' FROM inc WHERE component NOT IN (SELECT component FROM trig)""")
def plan(spark, sf):
    """Policy gate, playbook choice and justification."""
    a, inc, members = _incidents(spark, sf)
    p = response_plan(inc, a, members).join(inc.select("case_id", "component"), "case_id")
    return p.select("component", "action", F.col("step").cast("bigint").alias("step"), "justification")


@query("response_targets", _TRIG + """, w AS (SELECT component, arg_min(user_name, (first_s, alert_id)) AS u, arg_min(source_ip, (first_s, alert_id)) AS ip FROM trig GROUP BY 1)
SELECT component, action, CASE action WHEN 'disable_account' THEN u ELSE CASE WHEN ip LIKE '10.%' THEN '-' ELSE ip END END AS target,
 CASE WHEN action = 'block_ip_at_waf' AND ip LIKE '10.%' THEN 'SKIPPED - no external address in evidence' ELSE 'recommended' END AS result
FROM act JOIN w USING (component) WHERE action IN ('block_ip_at_waf', 'disable_account')""")
def targets(spark, sf):
    """Targets from triggering evidence with safety guards."""
    a, inc, members = _incidents(spark, sf)
    p = response_plan(inc, a, members).join(inc.select("case_id", "component"), "case_id")
    return p.filter(F.col("action").isin("block_ip_at_waf", "disable_account")).select(
        "component", "action", "target", "result")


@query("containment", _TRIG + """ SELECT component, CASE WHEN component IN (SELECT component FROM act) THEN 'contained' ELSE 'new' END AS status,
 CASE WHEN component IN (SELECT component FROM act) THEN last_s + 1080 END AS contained_s FROM inc""")
def containment(spark, sf):
    """Incidents with a response are stamped contained."""
    a, inc, members = _incidents(spark, sf)
    c = contain(inc, response_plan(inc, a, members))
    return c.select("component", "status", secs("contained_at").alias("contained_s"))


@query("ops_metrics", _TRIG + """, dur AS (SELECT last_s + 1080 - opened_s AS d FROM inc WHERE component IN (SELECT component FROM act))
SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM inc) AS incidents, (SELECT count(*) FROM act) AS response_actions,
 CAST(240 AS BIGINT) AS mttd_seconds, (SELECT median(d) FROM dur) AS mttr_seconds,
 (SELECT count(*) FROM sc WHERE score >= 55) AS alerts_scored_ge_55, CAST(33.3 AS DOUBLE) AS detection_gap_pct""")
def metrics(spark, sf):
    """Operations figures (M1)."""
    a, inc, members = _incidents(spark, sf)
    p = materialize(response_plan(inc, a, members), "plan")
    rules = rules_frame(spark, load_rules([{"id": i, "condition": {}} for i in ("R-ERR", "R-BUY", "R-IDLE")]))
    m = V.ops_metrics(events(spark, sf).count(), contain(inc, p), p, a, rules, 1.0)
    return m.select("events", "incidents", "response_actions", F.col("mttd_seconds").cast("bigint").alias("mttd_seconds"),
                    "mttr_seconds", "alerts_scored_ge_55", "detection_gap_pct")


@query("kpi_row", _TRIG + """ SELECT (SELECT count(*) FROM sc) AS alerts, (SELECT count(*) FROM inc) AS incidents,
 (SELECT count(DISTINCT rule_id) FROM sc) AS rules_fired, (SELECT count(*) FROM act) AS auto_actions,
 round(100.0 * (SELECT count(DISTINCT component) FROM act) / (SELECT count(*) FROM inc))::DOUBLE AS containment_rate,
 (SELECT count(*) FROM sc WHERE severity = 'critical') AS sev_critical, (SELECT count(*) FROM sc WHERE severity = 'low') AS sev_low""")
def kpis(spark, sf):
    """Dashboard totals in one row (M8)."""
    a, inc, members = _incidents(spark, sf)
    p = materialize(response_plan(inc, a, members), "plan")
    return V.kpi_row(a, contain(inc, p), p).select("alerts", "incidents", "rules_fired", "auto_actions",
                                                   "containment_rate", "sev_critical", "sev_low")


@query("evidence_export", _INC + """, rk AS (SELECT component, row_number() OVER (ORDER BY score DESC, opened_s, component) AS rank FROM inc)
SELECT m.alert_id IS NOT NULL AS mapped, 'INC-20240131-' || CASE WHEN rank < 1000 THEN lpad(rank::VARCHAR, 3, '0') ELSE rank::VARCHAR END AS case_id, m.score, m.rule_id, m.user_name AS "user",
 coalesce(m.host_name, CASE source_ip WHEN '10.10.31.27' THEN 'WS-FINANCE-07' WHEN '10.10.31.44' THEN 'WS-HR-03' ELSE '' END) AS host,
 m.n AS events, first_s FROM m JOIN rk USING (component)""")
def export(spark, sf):
    """Alerts with their incident, joined on the alert (M7)."""
    a, inc, members = _incidents(spark, sf)
    x = V.evidence_export(a, inc, members)
    return x.select((F.col("case_id") != "").alias("mapped"), "case_id", F.col("score").cast("bigint").alias("score"),
                    "rule_id", "user", "host", "events", secs("first_seen").alias("first_s"))


@query("incidents_by_score", _INC + " SELECT component, score FROM inc ORDER BY score DESC, opened_s, component LIMIT 25")
def by_score(spark, sf):
    """The 25 worst incidents (M9)."""
    _, inc, _ = _incidents(spark, sf)
    return V.incidents_by_score(inc).select("component", F.col("score").cast("bigint").alias("score"))


# ---------------------------------------------------------------- journal and views
@query("latest_decision", """SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn, arg_max(length(text), turn) AS chars
FROM conversations GROUP BY conv_id""")
def latest(spark, sf):
    """Last entry per key of an append-only log (M2)."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("chars"))
    return V.latest_decisions(c, "conv_id", "turn").select("conv_id", "role", "turn", "chars")


@query("triage_fold", """WITH j AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1)
SELECT 'C-' || user_id AS case_id, CASE t WHEN 'error' THEN 'closed' WHEN 'view' THEN 'closed' WHEN 'click' THEN 'contained' ELSE 'new' END AS status,
 CASE WHEN t IN ('error', 'view') THEN 1706659200::BIGINT END AS closed_s, t = 'error' AS false_positive,
 CASE WHEN t = 'error' THEN 'R-ERR' END AS fp_rule, CASE WHEN t IN ('error', 'view', 'click') THEN 'analyst.onshift' END AS assignee FROM j""")
def triage(spark, sf):
    """Latest decisions folded into incidents (M2 M3)."""
    e = events(spark, sf)
    cases = e.select(F.concat(F.lit("C-"), F.col("user_id").cast("string")).alias("case_id")).distinct().select(
        "case_id", F.lit("new").alias("status"), F.lit(None).cast("string").alias("assignee"),
        F.lit(None).cast("timestamp").alias("closed_at"), F.array(F.lit("R-ERR")).alias("rules"))
    status = (F.when(F.col("event_type") == "error", "false-positive").when(F.col("event_type") == "view", "closed")
              .when(F.col("event_type") == "click", "contained"))
    journal = e.select(F.concat(F.lit("C-"), F.col("user_id").cast("string")).alias("case_id"), status.alias("status"),
                       F.lit(None).cast("string").alias("assignee"), F.lit("n").alias("note"), F.col("event_id").alias("seq"))
    decided = V.latest_decisions(journal).filter("status IS NOT NULL")
    out = V.apply_decisions(cases, decided, "2024-01-31 00:00:00")
    return out.select("case_id", "status", secs("closed_at").alias("closed_s"), "false_positive", "fp_rule", "assignee")


@query("timeline_30m", "WITH " + ALERTS_SQL + """, e AS (SELECT CAST(floor(epoch_us(ts) / 1800000000) AS BIGINT) * 1800 AS b, count(*) AS n FROM events GROUP BY 1),
a AS (SELECT CAST(floor(first_s / 1800) AS BIGINT) * 1800 AS b, count(*) AS n, count(*) FILTER (severity = 'critical') AS c FROM al GROUP BY 1)
SELECT coalesce(e.b, a.b) AS bucket_s, coalesce(e.n, 0) AS events, coalesce(a.n, 0) AS alerts, coalesce(a.c, 0) AS critical
FROM e FULL JOIN a ON a.b = e.b ORDER BY 1 DESC LIMIT 40""")
def timeline(spark, sf):
    """Half-hour timeline, newest forty buckets (M4)."""
    t = V.half_hour_timeline(events(spark, sf), day_alerts(spark, sf))
    return t.select(secs("bucket").alias("bucket_s"), "events", "alerts", "critical")


_COV = "WITH " + CAPTURE_SQL + """, f AS (SELECT 'SOC-C2-021' AS rule_id, event_seq FROM cap WHERE event_dataset = 'web' AND url_path = '/gate.php'
 UNION ALL SELECT 'SOC-C2-022', event_seq FROM cap WHERE event_dataset = 'proxy' AND destination_domain = 'cdn-update-service.net'
 UNION ALL SELECT 'SOC-INIT-033', event_seq FROM cap WHERE event_dataset = 'web' AND url_path = '/.env'),
r(rule_id, tactic) AS (VALUES ('SOC-C2-021', 'command-and-control'), ('SOC-C2-022', 'command-and-control'), ('SOC-INIT-033', 'initial-access'),
 ('SOC-CRED-013', 'credential-access'), ('SOC-RANSOM-031', 'impact'))"""
_COV_IDS = ["SOC-C2-021", "SOC-C2-022", "SOC-INIT-033", "SOC-CRED-013", "SOC-RANSOM-031"]


def _hit_rows(spark, sf):
    rules = pack(*_COV_IDS)
    hits = rule_hits(capture(spark, sf), rules)
    ids = F.array(*[F.lit(r.id) for r in rules])
    meta = rules_frame(spark, rules)
    return hits.select(ids[F.col("rule_ix")].alias("rule_id")), meta


@query("rule_coverage", _COV + " SELECT r.rule_id, count(f.event_seq) AS hits FROM r LEFT JOIN f USING (rule_id) GROUP BY 1")
def coverage(spark, sf):
    """Hits per rule including idle rules (M5)."""
    hits, meta = _hit_rows(spark, sf)
    return V.rule_coverage(meta, hits).select("rule_id", "hits")


@query("idle_rules", _COV + " SELECT rule_id FROM r WHERE rule_id NOT IN (SELECT rule_id FROM f)")
def idle(spark, sf):
    """Rules that never fired (M5)."""
    hits, meta = _hit_rows(spark, sf)
    return V.idle_rules(meta, hits).select("rule_id")


@query("tactic_coverage", _COV + """ SELECT tactic, count(*) AS rules, count(*) FILTER (rule_id IN (SELECT rule_id FROM f)) AS fired
FROM r GROUP BY 1""")
def tactics(spark, sf):
    """Rules and fired rules per tactic."""
    hits, meta = _hit_rows(spark, sf)
    return V.tactic_coverage(meta, hits)


@query("attack_coverage", "WITH " + ALERTS_SQL + """, x AS (SELECT tactic, 'T' || length(tactic) AS technique FROM al UNION ALL SELECT tactic, rule_id FROM al)
SELECT count(DISTINCT tactic) AS tactics, count(DISTINCT technique) AS techniques FROM x""")
def attack(spark, sf):
    """Distinct tactics and techniques seen (M6)."""
    return V.attack_coverage(day_alerts(spark, sf))
