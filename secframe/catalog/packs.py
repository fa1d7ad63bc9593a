"""The whole shipped rule pack next to SQL, on a view of the events in which every rule finds something."""
from __future__ import annotations

from pyspark.sql import functions as F

from secframe.catalog.base import _DUCK, _SPARK, query, secs, spread, table
from secframe.functions.net import is_internal
from secframe.plans.detect import detect
from secframe.plans.rulepack import RULES

# what happens in an event; the same text runs in both engines
_SCENE = "CASE WHEN event_id < 180 THEN 25 WHEN (event_id * 7 + user_id) % 40 = 25 THEN 39 ELSE (event_id * 7 + user_id) % 40 END"
_BASE = "SELECT event_id AS n, user_id AS u, {secs} AS s0, " + _SCENE + " AS sc FROM {src}"
_FIELDS = [
    ("event_seq", "n"),
    # a month in 3.6 hours; the polling process reports once a minute
    ("ts_s", "CASE WHEN sc = 25 THEN 1704067200 + n * 60 ELSE 1704067200 + CAST(floor((s0 - 1704067200) / 200) AS BIGINT) END"),
    ("event_dataset", "CASE WHEN sc IN (0, 1, 2, 3, 4, 5, 8, 9, 11) THEN 'authentication' WHEN sc IN (6, 7) THEN 'auth' WHEN sc IN (10, 23, 37) THEN 'web' "
                      "WHEN sc IN (24, 25) THEN 'proxy' WHEN sc IN (20, 21, 22, 26, 27, 38) THEN 'firewall' WHEN sc IN (12, 13, 14, 16, 17, 18, 19) THEN 'process_creation' "
                      "WHEN sc = 15 THEN 'process_access' WHEN sc IN (28, 29, 30) THEN 'dns' WHEN sc BETWEEN 31 AND 36 THEN 'file_event' ELSE 'other' END"),
    ("event_action", "CASE WHEN sc <= 5 THEN 'failed-logon' WHEN sc IN (6, 7) THEN 'authentication-failure' WHEN sc IN (8, 9) THEN 'successful-logon' "
                     "WHEN sc IN (20, 21, 22) THEN 'deny' WHEN sc IN (26, 27, 38) THEN 'allow' WHEN sc IN (35, 36) THEN 'file-delete' ELSE 'noted' END"),
    ("event_id", "CASE WHEN sc = 11 THEN CASE WHEN n % 2 = 0 THEN '4720' ELSE '4732' END WHEN sc = 17 AND n % 2 = 0 THEN '1102' END"),
    ("source_ip", "CASE WHEN sc <= 5 THEN '203.0.113.' || (44 + n % 2) WHEN sc IN (6, 7) THEN '45.155.205.10' WHEN sc = 8 THEN '203.0.113.44' "
                  "WHEN sc = 9 THEN CASE WHEN n % 2 = 0 THEN '203.0.113.9' ELSE '198.51.100.9' END WHEN sc = 10 THEN '198.51.100.23' WHEN sc IN (20, 21, 22) THEN '192.0.2.50' "
                  "WHEN sc = 26 THEN '10.1.1.' || (u % 20) WHEN sc = 27 THEN '10.1.1.7' WHEN sc IN (28, 29, 30) THEN '10.1.2.' || (u % 2) WHEN sc = 25 THEN '10.1.3.3' "
                  "WHEN sc = 38 THEN '10.1.4.4' WHEN sc IN (23, 37) THEN '104.28.55.9' WHEN sc = 24 THEN '10.1.5.' || (u % 30) END"),
    ("user_name", "CASE WHEN sc <= 5 THEN 'user' || (u % 400) WHEN sc = 9 THEN 'trav' || (u % 5) WHEN sc = 11 THEN 'adm' || (u % 3) WHEN sc BETWEEN 12 AND 19 THEN 'u' || (u % 10) END"),
    ("host_name", "CASE WHEN sc IN (12, 38) THEN 'WS-1' WHEN sc = 19 THEN 'WS-' || (u % 3) WHEN sc IN (31, 32, 33) THEN 'FS-1' WHEN sc IN (35, 36) THEN 'FS-2' "
                  "WHEN sc = 34 THEN 'FS-' || (u % 5) WHEN sc BETWEEN 13 AND 18 THEN 'WS-' || (u % 20) END"),
    ("destination_ip", "CASE WHEN sc = 27 THEN '198.51.100.77' WHEN sc = 38 THEN '10.10.20.30' END"),
    ("destination_port", "CASE WHEN sc IN (20, 21, 22) THEN n % 1000 WHEN sc IN (27, 38) THEN CAST(445 AS BIGINT) END"),
    ("destination_domain", "CASE WHEN sc = 24 THEN 'exfil-drop.cloud' WHEN sc = 25 THEN 'poll.example' END"),
    ("process_name", "CASE WHEN sc = 12 THEN 'powershell.exe' WHEN sc = 14 THEN 'cmd.exe' WHEN sc = 25 THEN 'poller.exe' END"),
    ("process_parent", "CASE WHEN sc = 14 THEN 'outlook.exe' END"),
    ("process_command_line", "CASE WHEN sc = 12 THEN 'powershell -enc aaaabbbbccccddddeeee' || CASE WHEN n % 5 = 0 THEN ' https://x.githubusercontent.com/y' ELSE '' END "
                             "WHEN sc = 13 THEN 'schtasks /create /tn x /tr appdata/x.exe' WHEN sc = 16 THEN 'vssadmin delete shadows /all' "
                             "WHEN sc = 17 AND n % 2 = 1 THEN 'wevtutil cl security' WHEN sc = 18 THEN 'netsh advfirewall set allprofiles state off' "
                             "WHEN sc = 19 THEN CASE WHEN n % 2 = 0 THEN 'whoami /priv' ELSE 'systeminfo' END END"),
    ("target_process", "CASE WHEN sc = 15 THEN 'lsass.exe' END"), ("access_mask", "CASE WHEN sc = 15 THEN '0x1010' END"),
    ("dns_question_name", "CASE WHEN sc = 28 THEN 'abcdefghijkl' || (u % 9) || '.net' WHEN sc = 29 THEN 'plain.example' WHEN sc = 30 THEN 'qwerty' || (u % 7) || '.a1f3-update.net' END"),
    ("dns_rcode", "CASE WHEN sc IN (28, 29, 30) THEN 'NOERROR' END"),
    ("network_bytes", "CASE WHEN sc = 29 THEN CAST(3000 AS BIGINT) WHEN sc = 26 THEN CAST(200000000 AS BIGINT) ELSE CAST(100 AS BIGINT) END"),
    ("network_direction", "CASE WHEN sc = 25 THEN 'outbound' END"),
    ("url_path", "CASE WHEN sc = 10 THEN '/owa/auth.owa' WHEN sc = 23 THEN '/gate.php' WHEN sc = 37 THEN '/.env' END"),
    ("http_response_status_code", "CASE WHEN sc = 10 THEN CAST(401 AS BIGINT) END"),
    ("file_path", "CASE WHEN sc IN (31, 32, 33) THEN '/data/f' || n || '.locked' WHEN sc = 34 THEN '/data/how_to_recover.txt' "
                  "WHEN sc IN (35, 36) THEN replace('/users/ann/documents/f' || n || '.txt', '/', chr(92)) END"),
]
_SELECT = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _FIELDS) + " FROM (" + _BASE + ") b"

_LOGON, _PC = "event_dataset IN ('authentication', 'auth')", "event_dataset = 'process_creation'"
_EXT = "source_ip IS NOT NULL AND source_ip NOT LIKE '10.%'"
_FAIL = "event_action IN ('failed-logon', 'authentication-failure')"
# rule -> (predicate, key, events, minutes, distinct field, distinct values)
_THRESHOLD = {
    "SOC-BRUTE-001": (f"{_LOGON} AND {_FAIL} AND {_EXT}", "source_ip", 30, 15, None, 0),
    "SOC-BRUTE-002": ("event_dataset = 'auth' AND event_action = 'authentication-failure' AND source_ip IS NOT NULL", "source_ip", 10, 10, None, 0),
    "SOC-CSTUF-004": (f"{_LOGON} AND {_FAIL} AND {_EXT}", "source_ip", 6, 15, "user_name", 6),
    "SOC-OWA-006": ("event_dataset = 'web' AND url_path LIKE '%auth.owa%' AND http_response_status_code = 401", "source_ip", 5, 15, None, 0),
    "SOC-DISC-017": (f"{_PC} AND process_command_line IN ('whoami /priv', 'systeminfo')", "host_name", 3, 10, None, 0),
    "SOC-SCAN-020": ("event_dataset = 'firewall' AND event_action = 'deny' AND destination_port IS NOT NULL AND source_ip <> '203.0.113.77'", "source_ip", 10, 5, "destination_port", 10),
    "SOC-EXFIL-024": ("event_dataset IN ('web', 'proxy', 'firewall') AND network_bytes >= 100000000", "source_ip", 1, 30, None, 0),
    "SOC-DGA-026": ("event_dataset = 'dns' AND (dns_question_name LIKE 'abcdefghijkl%' OR dns_question_name LIKE '%-update.net')", "source_ip", 4, 15, None, 0),
    "SOC-DNSTUN-027": ("event_dataset = 'dns' AND network_bytes >= 2500", "source_ip", 10, 15, None, 0),
    "SOC-DNS-028": ("event_dataset = 'dns' AND dns_rcode = 'NOERROR' AND dns_question_name LIKE '%.a1f3-update.net'", "source_ip", 1, 15, None, 0),
    "SOC-RANSOM-030": ("file_path LIKE '%.locked'", "host_name", 25, 10, None, 0),
    "SOC-DESTROY-032": ("event_action = 'file-delete' AND file_path LIKE '%documents%'", "host_name", 20, 15, None, 0),
}
_SINGLE = {
    "SOC-PSH-010": f"{_PC} AND process_name LIKE '%powershell%' AND process_command_line LIKE '%-enc %' AND process_command_line NOT LIKE '%githubusercontent.com%'",
    "SOC-PERSIST-011": f"{_PC} AND process_command_line LIKE 'schtasks /create%appdata%'",
    "SOC-PROC-012": f"{_PC} AND process_parent = 'outlook.exe' AND process_name = 'cmd.exe'",
    "SOC-CRED-013": "event_dataset = 'process_access' AND target_process = 'lsass.exe' AND access_mask = '0x1010'",
    "SOC-EVADE-014": f"{_PC} AND process_command_line LIKE 'vssadmin%delete shadows%'",
    "SOC-EVADE-015": "event_dataset IN ('process_creation', 'log_clearing', 'authentication') AND (process_command_line LIKE 'wevtutil cl%' OR event_id = '1102')",
    "SOC-EVADE-016": f"{_PC} AND process_command_line LIKE 'netsh advfirewall set%state off%'",
    "SOC-C2-021": "event_dataset IN ('web', 'proxy') AND url_path = '/gate.php'",
    "SOC-C2-022": "event_dataset IN ('web', 'proxy', 'dns') AND destination_domain = 'exfil-drop.cloud'",
    "SOC-EXFIL-025": "event_dataset = 'firewall' AND destination_port = 445 AND destination_ip NOT LIKE '10.%' AND event_action = 'allow'",
    "SOC-RANSOM-031": "event_dataset = 'file_event' AND file_path LIKE '%how_to_recover.txt'",
    "SOC-INIT-033": "event_dataset = 'web' AND url_path = '/.env'",
}
# rule -> (hit, prior, key, priors, minutes)
_SEQUENCE = {
    "SOC-LOGIN-003": (f"{_LOGON} AND event_action = 'successful-logon' AND {_EXT}", f"{_FAIL} AND {_EXT}", "source_ip", 10, 30),
    "SOC-ACCT-007": (f"{_LOGON} AND event_id = '4732'", "event_id = '4720'", "user_name", 1, 20),
    "SOC-LATERAL-034": ("event_dataset = 'firewall' AND destination_port = 445 AND event_action = 'allow' AND source_ip IS NOT NULL", "process_name LIKE '%powershell%'", "host_name", 1, 60),
}


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


_PACK_SQL = "WITH RECURSIVE fc AS (" + _SELECT.replace("{src}", "events").replace("{secs}", _DUCK["secs"]) + "),\nth AS (" + _union(
    f"SELECT '{r}' AS rule_id, coalesce({key}, '?') AS key, ts_s, CAST({d or 'NULL'} AS VARCHAR) AS d, {n} AS least, {m * 60} AS span, {v} AS variety FROM fc WHERE {p}"
    for r, (p, key, n, m, d, v) in _THRESHOLD.items()) + """),
thg AS (SELECT rule_id, count(*) AS n, min(ts_s) AS f, max(ts_s) AS l FROM th GROUP BY rule_id, key, (ts_s - (SELECT min(ts_s) FROM fc)) // span
  HAVING count(*) >= max(least) AND count(DISTINCT d) >= max(variety)),
si AS (""" + _union(f"SELECT '{r}' AS rule_id, source_ip, host_name, user_name, ts_s FROM fc WHERE {p}" for r, p in _SINGLE.items()) + """),
sig AS (SELECT rule_id, count(*) AS n, min(ts_s) AS f, max(ts_s) AS l FROM si GROUP BY rule_id, source_ip, host_name, user_name),
sh AS (""" + _union(f"SELECT DISTINCT '{r}' AS rule_id, coalesce({k}, '?') AS key, ts_s AS t, {n} AS least, {m * 60} AS span FROM fc WHERE {h}"
                    for r, (h, _, k, n, m) in _SEQUENCE.items()) + """),
sp AS (""" + _union(f"SELECT '{r}' AS rule_id, coalesce({k}, '?') AS key, ts_s AS t FROM fc WHERE {p}" for r, (_, p, k, _, _) in _SEQUENCE.items()) + """),
sq AS (SELECT sh.rule_id, sh.key, sh.t, span, count(*) AS priors, min(sp.t) AS f FROM sh JOIN sp ON sp.rule_id = sh.rule_id AND sp.key = sh.key AND sp.t BETWEEN sh.t - span AND sh.t
  GROUP BY ALL HAVING count(*) >= max(least)),
fired(rule_id, key, t, span) AS (SELECT rule_id, key, min(t), min(span) FROM sq GROUP BY 1, 2
  UNION ALL SELECT x.rule_id, x.key, min(sq.t), x.span FROM fired x JOIN sq ON sq.rule_id = x.rule_id AND sq.key = x.key AND sq.t > x.t + x.span GROUP BY x.rule_id, x.key, x.t, x.span),
sqg AS (SELECT rule_id, 1 + least(2, sq.priors) AS n, sq.f, sq.t AS l FROM fired JOIN sq USING (rule_id, key, t)),
place(p, lat, lon) AS (VALUES ('203.0.113.', -26.2041::DOUBLE, 28.0473::DOUBLE), ('198.51.100.', -23.5505, -46.6333)),
tl AS (SELECT user_name, ts_s, lat, lon, lag(ts_s) OVER w AS a_s, lag(lat) OVER w AS a_lat, lag(lon) OVER w AS a_lon FROM fc JOIN place ON starts_with(source_ip, p)
  WHERE """ + _LOGON + """ AND event_action = 'successful-logon' WINDOW w AS (PARTITION BY coalesce(user_name, '?') ORDER BY ts_s, event_seq)),
tg AS (SELECT 'SOC-IMPTVL-005' AS rule_id, 2 AS n, arg_min(a_s, ts_s) AS f, min(ts_s) AS l FROM tl WHERE ts_s > a_s AND ts_s - a_s <= 3600 AND (lat <> a_lat) GROUP BY coalesce(user_name, '?')),
bh AS (SELECT coalesce(source_ip, '?') || '|' || coalesce(destination_domain, '?') AS key, ts_s FROM fc WHERE event_dataset IN ('web', 'proxy') AND network_direction = 'outbound' AND process_name IS NOT NULL),
bc AS (SELECT key, ts_s, count(*) OVER (PARTITION BY key ORDER BY ts_s RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW) AS n FROM bh),
bd AS (SELECT key, max(n) AS n, arg_max(ts_s, (n, -ts_s)) AS e FROM bc GROUP BY key HAVING max(n) >= 12),
bp AS (SELECT bd.key, bd.n, bh.ts_s, bh.ts_s - lag(bh.ts_s) OVER (PARTITION BY bd.key ORDER BY bh.ts_s) AS gap FROM bd JOIN bh ON bh.key = bd.key AND bh.ts_s BETWEEN bd.e - 1800 AND bd.e),
bg AS (SELECT 'SOC-C2-023' AS rule_id, max(n) AS n, min(ts_s) AS f, max(ts_s) AS l FROM bp GROUP BY key HAVING avg(gap) BETWEEN 20 AND 600 AND stddev_pop(gap) / avg(gap) <= 0.08),
every AS (SELECT rule_id, n, f, l FROM thg UNION ALL SELECT rule_id, n, f, l FROM sig UNION ALL SELECT rule_id, n, f, l FROM sqg UNION ALL SELECT rule_id, n, f, l FROM tg UNION ALL SELECT rule_id, n, f, l FROM bg)
SELECT rule_id, count(*) AS alerts, CAST(sum(n) AS BIGINT) AS events, CAST(min(f) AS BIGINT) AS first_s, CAST(max(l) AS BIGINT) AS last_s FROM every GROUP BY 1"""


def scenes(spark, sf):
    """Events in which something for every shipped rule happens."""
    e = spread(table(spark, sf, "events"))
    df = spark.sql(_SELECT.replace("{secs}", _SPARK["secs"]), src=e)
    return df.withColumns({"ts": F.timestamp_seconds("ts_s"), "source_ip_not_private": ~is_internal(F.col("source_ip")),
                           "destination_ip_not_private": ~is_internal(F.col("destination_ip"))})


@query("rule_pack_alerts", _PACK_SQL)
def rule_pack_alerts(spark, sf):
    """All 29 shipped rules in one run: alerts, their events and times per rule."""
    a = detect(scenes(spark, sf), RULES, fold=False)
    return a.groupBy("rule_id").agg(F.count(F.lit(1)).alias("alerts"), F.sum("count").alias("events"),
                                    secs(F.min("first_seen")).alias("first_s"), secs(F.max("last_seen")).alias("last_s"))
