"""Enrichment and scoring queries over day alerts."""
from __future__ import annotations

from pyspark.sql import functions as F

from secframe.catalog.base import ALERTS_SQL, day_alerts, query, secs, table
from secframe.operators.correlate import dedup_alerts
from secframe.operators.enrich import (_exploded, asset_hosts, domain_suffixes, enrich,
                                       host_attributes, is_privileged, match_domains, match_ips,
                                       mfa_enrolled, triage_level, user_risk)
from secframe.operators.views import false_positive_candidates, median_seconds, severity_counts, top_alerts
from secframe.plans import settings as cfg

AL = "WITH " + ALERTS_SQL
INTEL_IP = """ip(ip, category, conf) AS (VALUES ('203.0.113.44', 'brute-force', 88), ('198.51.100.23', 'scanner', 71),
 ('192.0.2.99', 'c2', 94), ('45.155.205.10', 'anonymizer', 66), ('203.0.113.77', 'info-sec-scanning', 20)),
hit AS (SELECT alert_id, source_ip, coalesce(ip.category, CASE WHEN source_ip LIKE '45.155.205.%' THEN 'anonymizer' END) AS category,
 coalesce(ip.conf, CASE WHEN source_ip LIKE '45.155.205.%' THEN 60 END) AS confidence FROM al LEFT JOIN ip ON ip.ip = al.source_ip)"""
INTEL_DOM = """dom AS (SELECT alert_id, destination_domain, CASE WHEN destination_domain = 'a.cdn-update-service.net' THEN 'c2' ELSE 'exfil-host' END AS category,
 CASE WHEN destination_domain = 'a.cdn-update-service.net' THEN 90 ELSE 84 END AS confidence FROM al
 WHERE destination_domain IN ('a.cdn-update-service.net', 'exfil-drop.cloud'))"""
PRIV = "(user_name LIKE 'admin%' OR user_name LIKE 'svc-%')"
SCORED_SQL = ALERTS_SQL + ", " + INTEL_IP + ", " + INTEL_DOM + f""",
conf AS (SELECT al.alert_id, greatest(max(hit.confidence), max(dom.confidence)) AS c FROM al LEFT JOIN hit USING (alert_id)
  LEFT JOIN dom USING (alert_id) GROUP BY 1),
pts AS (SELECT al.*, conf.c,
  CASE severity WHEN 'critical' THEN 60 WHEN 'high' THEN 45 WHEN 'medium' THEN 30 WHEN 'low' THEN 15 ELSE 5 END::DOUBLE
  + risk * 0.15::DOUBLE
  + CASE WHEN source_ip NOT LIKE '10.%' THEN 6 ELSE 0 END
  + CASE WHEN conf.c IS NOT NULL THEN 15 + greatest(0, (conf.c - 60) / 2.0::DOUBLE) ELSE 0 END
  + CASE WHEN {PRIV} THEN 12 ELSE 0 END + CASE WHEN user_name LIKE 'svc-%' THEN 8 ELSE 0 END
  + CASE WHEN coalesce(host_name, '') LIKE 'SRV-%' THEN 10 ELSE 0 END
  + CASE WHEN 2 + CASE WHEN coalesce(host_name, CASE WHEN source_ip IN ('10.10.31.27', '10.10.31.44') THEN 'x' END) IS NOT NULL THEN 1 ELSE 0 END
     + CASE WHEN destination_domain IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN process_name IS NOT NULL THEN 1 ELSE 0 END >= 5 THEN 5 ELSE 0 END
  + CASE WHEN mx >= 100000000 THEN 10 ELSE 0 END + CASE WHEN prior_events > 0 THEN 10 ELSE 0 END AS points
  FROM al JOIN conf USING (alert_id)),
sc AS (SELECT *, CAST(round_even(least(100.0, points), 0) AS BIGINT) AS score FROM pts)"""


@query("intel_ip_match", AL + ", " + INTEL_IP + " SELECT alert_id, category, CAST(confidence AS BIGINT) AS confidence FROM hit WHERE category IS NOT NULL")
def intel_ip(spark, sf):
    """Exact feed addresses, anonymizer networks as fallback."""
    hits = match_ips(_exploded(day_alerts(spark, sf), "source_ip", "destination_ip"),
                     cfg.intel_ip(spark), cfg.geo_prefixes(spark))
    return hits.select("alert_id", "category", F.col("confidence").cast("bigint").alias("confidence"))


@query("intel_domain_match", AL + ", " + INTEL_DOM + " SELECT alert_id, destination_domain AS value, category, CAST(confidence AS BIGINT) AS confidence FROM dom")
def intel_domain(spark, sf):
    """Feed suffixes at label boundaries."""
    hits = match_domains(_exploded(day_alerts(spark, sf), "destination_domain"), cfg.intel_domain(spark))
    return hits.select("alert_id", "value", "category", F.col("confidence").cast("bigint").alias("confidence"))


@query("page_domain_suffix", r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host FROM pages),
feed(suffix, feed_rank) AS (VALUES ('example.com', 0), ('m.example.net', 1), ('example.net', 2), ('ple.org', 3))
SELECT page_id, host, arg_min(suffix, feed_rank) AS suffix FROM h JOIN feed ON host = suffix OR host LIKE '%.' || suffix GROUP BY 1, 2""")
def page_suffix(spark, sf):
    """Suffix match of page hosts against a feed: label expansion and a hash join."""
    feed = spark.createDataFrame([("example.com", 0), ("m.example.net", 1), ("example.net", 2), ("ple.org", 3)],
                                 "suffix string, feed_rank int")
    host = F.lower(F.regexp_extract("url", "://([^/?#:]+)", 1))
    tried = table(spark, sf, "pages").select("page_id", host.alias("host")).select(
        "page_id", "host", F.explode(domain_suffixes(F.col("host"))).alias("suffix"))
    return tried.join(feed, "suffix").groupBy("page_id", "host").agg(
        F.min_by("suffix", "feed_rank").alias("suffix"))


@query("asset_hosts", AL + """ SELECT alert_id, CASE source_ip WHEN '10.10.31.27' THEN 'WS-FINANCE-07' ELSE 'WS-HR-03' END AS host
FROM al WHERE host_name IS NULL AND source_ip IN ('10.10.31.27', '10.10.31.44')""")
def assets(spark, sf):
    """Hosts filled from the asset inventory (E5)."""
    return asset_hosts(day_alerts(spark, sf), cfg.assets(spark)).select(
        "alert_id", F.array_join("asset_hosts", ",").alias("host"))


@query("entity_attributes", AL + f""" SELECT alert_id, {PRIV} AS privileged, CAST(CASE WHEN {PRIV} THEN 35 ELSE 10 END AS BIGINT) AS user_risk,
 user_name NOT LIKE 'svc-%' AS mfa, CASE WHEN host_name LIKE 'SRV-%' THEN 'high' WHEN host_name LIKE 'WS-%' THEN 'medium' ELSE 'unknown' END AS criticality,
 CASE WHEN host_name LIKE 'SRV-%' THEN 'server-vlan' WHEN host_name LIKE 'WS-%' THEN 'user-vlan' ELSE 'unknown' END AS exposure FROM al""")
def attributes(spark, sf):
    """User and host attributes."""
    user, host = F.get(F.col("entities")["user_name"], F.lit(0)), F.get(F.col("entities")["host_name"], F.lit(0))
    h = host_attributes(host)
    return day_alerts(spark, sf).select(
        "alert_id", is_privileged(user).alias("privileged"), user_risk(user).cast("bigint").alias("user_risk"),
        mfa_enrolled(user).alias("mfa"), h["criticality"].alias("criticality"), h["exposure"].alias("exposure"))


@query("alert_score", "WITH " + SCORED_SQL + """ SELECT alert_id, score, CASE WHEN score >= 75 THEN 'escalate' WHEN score >= 55 THEN 'investigate'
 WHEN score >= 35 THEN 'monitor' ELSE 'close-fp' END AS triage, greatest(0, 1706659200 - last_s) AS latency_s FROM sc""")
def score(spark, sf):
    """Full enrichment: score, triage suggestion, latency."""
    a = enrich(day_alerts(spark, sf), run_ts="2024-01-31 00:00:00")
    return a.select("alert_id", F.col("score").cast("bigint").alias("score"), F.col("triage_suggested").alias("triage"),
                    F.col("detection_latency_s").alias("latency_s"))


@query("score_reasons", "WITH " + SCORED_SQL + f""" SELECT alert_id, concat_ws(';', 'rule severity ' || severity || ' + rule risk ' || risk,
  CASE WHEN source_ip NOT LIKE '10.%' THEN 'external source ' || source_ip END, CASE WHEN c IS NOT NULL THEN 'intel' END,
  CASE WHEN {PRIV} THEN 'privileged account ' || user_name END, CASE WHEN user_name LIKE 'svc-%' THEN 'MFA not enrolled' END,
  CASE WHEN host_name LIKE 'SRV-%' THEN 'high-criticality asset ' || host_name END) AS reasons FROM sc""")
def reasons(spark, sf):
    """Contributions behind each score."""
    kept = F.filter(F.col("score_reasons"), lambda r: ~r.rlike("distinct entity|largest single|sequence hit"))
    short = F.transform(kept, lambda r: F.when(r.startswith("threat intel"), F.lit("intel")).otherwise(r))
    return enrich(day_alerts(spark, sf)).select("alert_id", F.array_join(short, ";").alias("reasons"))


@query("alert_dedup", AL + """ SELECT rule_id, user_name, CAST(sum(n) AS BIGINT) AS n, min(first_s) AS first_s, max(last_s) AS last_s, count(*) AS alerts
FROM al GROUP BY rule_id, source_ip, host_name, user_name, destination_domain""")
def dedup(spark, sf):
    """Repeats of a rule on the same entities collapse across runs."""
    d = dedup_alerts(day_alerts(spark, sf))
    return d.select("rule_id", F.col("entities")["user_name"][0].alias("user_name"), F.col("count").alias("n"),
                    secs("first_seen").alias("first_s"), secs("last_seen").alias("last_s"),
                    F.coalesce("deduped_from", F.lit(1)).cast("bigint").alias("alerts"))


@query("severity_counts", AL + """, s(severity) AS (VALUES ('critical'), ('high'), ('medium'), ('low'), ('informational'))
SELECT s.severity, count(al.alert_id) AS n FROM s LEFT JOIN al ON al.severity = s.severity AND al.n >= 3 GROUP BY 1""")
def severities(spark, sf):
    """Zero-filled severity counts (M1)."""
    return severity_counts(day_alerts(spark, sf).filter("count >= 3")).select("severity", "n")


@query("median_latency", AL + " SELECT median(1706659200 - last_s) AS median_s FROM al")
def median(spark, sf):
    """Exact median detection latency by counts (M1)."""
    a = day_alerts(spark, sf).withColumn("lat", F.lit(1706659200) - F.unix_seconds("last_seen"))
    return median_seconds(a, "lat", "median_s")


@query("top_alerts", "WITH " + SCORED_SQL + " SELECT alert_id, score FROM sc ORDER BY score DESC, first_s, alert_id LIMIT 25")
def top(spark, sf):
    """The 25 highest alerts (M9)."""
    return top_alerts(enrich(day_alerts(spark, sf))).select("alert_id", F.col("score").cast("bigint").alias("score"))


@query("false_positive_candidates", "WITH " + SCORED_SQL + " SELECT alert_id, score FROM sc ORDER BY score, first_s, alert_id LIMIT 6")
def lowest(spark, sf):
    """The six lowest alerts (M9)."""
    return false_positive_candidates(enrich(day_alerts(spark, sf))).select(
        "alert_id", F.col("score").cast("bigint").alias("score"))
