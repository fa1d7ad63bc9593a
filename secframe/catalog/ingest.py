"""Ingest queries: lines rendered from the events table are parsed back by the sources."""
from __future__ import annotations

from pyspark.sql import functions as F

from secframe.catalog.base import events as all_events, query, secs, spread, table
from secframe.functions.net import in_networks, ipv4_number, is_internal
from secframe.functions.timeparse import parse_timestamp
from secframe.functions.values import basename_if_path, first_of
from secframe.operators.geo import locate
from secframe.operators.hits import rule_hits
from secframe.plans.rules import load_rules
from secframe.plans.settings import geo_prefixes
from secframe.session import scratch_path
from secframe.sources.normalize import conform
from secframe.sources.registry import (SOURCES, error_kinds, good_events, ingest_loss, parse_lines,
                                       read_events, write_events)

EPOCH = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"
FW_HEADER = "@timestamp,action,src_ip,src_port,dst_ip,dst_port,bytes,proto,rule,host,dst_domain"
DNS_HEADER = "\t".join(["@timestamp", "client_ip", "host", "query", "type", "answer", "rcode",
                        "response_bytes"])


def events(spark, sf):
    return spread(all_events(spark, sf))


def _iso():
    return F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000"))


def _s(c):
    return F.col(c).cast("string")


def json_lines(e):
    good = F.concat(
        F.lit('{"@timestamp":"'), _iso(), F.lit('","EventID":'),
        F.when(F.col("event_id") % 2 == 0, F.lit('"4625"')).otherwise(F.lit("4624")),
        F.lit(',"Computer":"-","HostName":"H'), _s("event_id"), F.lit('","TargetUserName":"u'),
        _s("user_id"), F.lit('","IpAddress":"'),
        F.when(F.col("user_id") % 3 == 0, F.lit("10.0.0.7")).otherwise(F.lit("203.0.113.9")),
        F.lit('","Vendor":"x"'), F.when(F.col("event_id") % 7 == 0, F.concat(
            F.lit(',"event.action":["failed-logon", "e'), _s("event_id"), F.lit('"],"User":["a","b"],"none":[]}'))).otherwise(F.lit("}")))
    m = F.col("event_id") % 50
    return e.select(F.when(m == 0, F.lit('{"@timestamp":"2024')).when(m == 1, F.lit("[1]"))
                    .when(m == 2, F.lit("  ")).when(m == 3, F.lit('{"@timestamp":"yesterday"}'))
                    .otherwise(good).alias("value"))


def apache_lines(e):
    status = F.when(F.col("event_type") == "error", "401").otherwise("200")
    good = F.concat(
        F.lit("203.0.113."), (F.col("user_id") % 250).cast("string"), F.lit(" - "),
        F.when(F.col("user_id") % 4 == 0, F.lit("-")).otherwise(F.concat(F.lit("u"), _s("user_id"))),
        F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /A/'),
        _s("event_id"), F.lit(' HTTP/1.1" '), status, F.lit(" "),
        F.when(F.col("event_id") % 5 == 0, F.lit("-")).otherwise(_s("event_id")),
        F.lit(' "-" "agent/1"\r'))
    return e.select(F.when(F.col("event_id") % 40 == 0, F.lit("garbage")).otherwise(good).alias("value"))


def syslog_lines(e):
    good = F.concat(
        F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" host"), _s("event_id"),
        F.lit(" sshd[7]: "), F.when(
            F.col("event_id") % 3 == 0,
            F.concat(F.lit("Failed password for root from 198.51.100."),
                     (F.col("user_id") % 250).cast("string"), F.lit(" port 22 ssh2")))
        .otherwise(F.concat(F.lit('action=authentication-success outcome=Success user="u '),
                            _s("user_id"), F.lit('" ip=10.1.1.1 rport=22 rport=51'))))
    return e.select(F.when(F.col("event_id") % 30 == 0, F.lit("not syslog")).otherwise(good).alias("value"))


def csv_lines(e):
    good = F.concat(_iso(), F.lit(",DENY,198.51.100.1,"), (F.col("user_id") + 1024).cast("string"),
                    F.lit(",10.0.0.5,445,"), _s("event_id"), F.lit(',tcp,"a,b",'),
                    F.concat(F.lit("H"), _s("event_id")))
    m = F.col("event_id") % 20
    return e.select(F.when(m == 0, F.concat(good, F.lit(",d.example,extra")))   # one field too many
                    .when(m == 1, good)                                          # one too few
                    .otherwise(F.concat(good, F.lit(",D.Example"))).alias("value"))


def dns_lines(e):
    return e.select(F.concat_ws("\t", _iso(), F.lit("10.1.1.1"), F.concat(F.lit("H"), _s("event_id")),
                                F.lit("X.Example.NET"), F.lit("A"), F.lit(""),
                                F.when(F.col("event_id") % 2 == 0, "NXDOMAIN").otherwise("NOERROR"),
                                _s("event_id")).alias("value"))


@query("ingest_json", f"""
SELECT 'H' || event_id AS host_name, {EPOCH} AS ts_s, 'u' || user_id AS user_name,
  CASE WHEN event_id % 7 = 0 THEN '["failed-logon","e' || event_id || '"]' WHEN event_id % 2 = 0 THEN 'failed-logon' ELSE 'successful-logon' END AS event_action,
  CASE WHEN event_id % 2 = 0 THEN 'failure' ELSE 'success' END AS event_outcome,
  CASE WHEN event_id % 2 = 0 THEN 'eventcode/4625' ELSE 'eventcode/4624' END AS tags,
  user_id % 3 <> 0 AS external, event_id % 2 = 0 AND event_id % 7 <> 0 AS failed, 'x' AS vendor,
  CASE WHEN event_id % 7 = 0 THEN 'failed-logon,e' || event_id END AS actions, CASE WHEN event_id % 2 = 0 THEN '4625' ELSE '4624' END AS raw_id
FROM events WHERE event_id % 50 > 3""")
def ingest_json(spark, sf):
    """JSON lines, vendor aliases, placeholders, event ids, flags and leftovers."""
    ev = good_events(parse_lines(json_lines(events(spark, sf)), SOURCES["auth"], "auth"))
    return ev.select("host_name", secs("ts").alias("ts_s"), "user_name", "event_action",
                     "event_outcome", F.array_join("tags", ",").alias("tags"),
                     F.col("source_ip_not_private").alias("external"),
                     F.coalesce("logon_failure", F.lit(False)).alias("failed"),
                     F.col("extra")["Vendor"].alias("vendor"), F.array_join(F.col("lists")["event.action"], ",").alias("actions"),
                     F.col("vendor")["EventID"].alias("raw_id"))


@query("ingested_lists", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'R-ANY,R-ALL,R-USER' || CASE WHEN event_id % 2 = 0 THEN ',R-RAW' ELSE '' END
   WHEN event_id % 2 = 0 THEN 'R-ANY,R-RAW' END AS fired
FROM events WHERE event_id % 50 > 3 AND (event_id % 7 = 0 OR event_id % 2 = 0)""")
def ingested_lists(spark, sf):
    """Rules on list-valued and raw vendor fields of ingested lines."""
    ev = good_events(parse_lines(json_lines(events(spark, sf)), SOURCES["auth"], "auth"))
    rules = load_rules([{"id": "R-ANY", "condition": {"event.action": "FAILED-logon"}}, {"id": "R-ALL", "condition": {"event.action": {"all": ["failed-logon"]}}},
                        {"id": "R-USER", "condition": {"user.name": ["zz", "B"]}}, {"id": "R-RAW", "condition": {"EventID": "4625", "none": {"exists": False}}}])
    hits = rule_hits(ev, rules)
    fired = F.array_join(F.transform(F.array_sort(F.collect_list("rule_ix")), lambda i: F.array(*[F.lit(r.id) for r in rules])[i]), ",")
    name = F.regexp_replace("host_name", "^H", "").cast("bigint")
    return hits.groupBy(name.alias("event_id")).agg(fired.alias("fired"))


@query("ingest_apache", f"""
SELECT '/a/' || event_id AS url_path, {EPOCH} AS ts_s, '203.0.113.' || (user_id % 250) AS source_ip,
  CASE WHEN user_id % 4 <> 0 THEN 'u' || user_id END AS user_name,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS event_outcome,
  CAST(CASE WHEN event_type = 'error' THEN 401 ELSE 200 END AS BIGINT) AS status,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id END AS network_bytes, 'inbound' AS direction,
  'ua:agent/1,web-request' AS tags
FROM events WHERE event_id % 40 <> 0""")
def ingest_apache(spark, sf):
    """Combined access log."""
    ev = good_events(parse_lines(apache_lines(events(spark, sf)), SOURCES["web"], "web"))
    return ev.select("url_path", secs("ts").alias("ts_s"), "source_ip", "user_name", "event_outcome",
                     F.col("http_response_status_code").alias("status"), "network_bytes",
                     F.col("network_direction").alias("direction"),
                     F.array_join("tags", ",").alias("tags"))


@query("ingest_syslog", f"""
SELECT 'host' || event_id AS host_name, {EPOCH} AS ts_s,
  CASE WHEN event_id % 3 = 0 THEN 'authentication-failure' ELSE 'authentication-success' END AS event_action,
  CASE WHEN event_id % 3 = 0 THEN 'failure' ELSE 'success' END AS event_outcome,
  CASE WHEN event_id % 3 = 0 THEN '198.51.100.' || (user_id % 250) ELSE '10.1.1.1' END AS source_ip,
  CASE WHEN event_id % 3 <> 0 THEN 'u ' || user_id END AS user_name,
  CASE WHEN event_id % 3 <> 0 THEN 51::BIGINT END AS source_port, 'sshd' AS process_name
FROM events WHERE event_id % 30 <> 0""")
def ingest_syslog(spark, sf):
    """Syslog with key=value pairs and plain sshd sentences; year as a parameter."""
    spec = {**SOURCES["ssh"], "year": 2024}
    ev = good_events(parse_lines(syslog_lines(events(spark, sf)), spec, "ssh"))
    return ev.select("host_name", secs("ts").alias("ts_s"), "event_action", "event_outcome",
                     "source_ip", "user_name", "source_port", "process_name")


@query("ingest_csv", f"""
SELECT 'H' || event_id AS host_name, {EPOCH} AS ts_s, 'deny' AS event_action,
  user_id + 1024 AS source_port, 445::BIGINT AS destination_port, event_id AS network_bytes,
  'a,b' AS firewall_rule, CASE WHEN event_id % 20 <> 1 THEN 'd.example' END AS destination_domain,
  false AS dst_external, 'outbound' AS direction
FROM events WHERE event_id % 20 <> 0""")
def ingest_csv(spark, sf):
    """Delimited rows: quoting, short and long rows, numeric coercion."""
    ev = good_events(parse_lines(csv_lines(events(spark, sf)), SOURCES["firewall"], "firewall", FW_HEADER))
    return ev.select("host_name", secs("ts").alias("ts_s"), "event_action", "source_port",
                     "destination_port", "network_bytes", "firewall_rule", "destination_domain",
                     F.col("destination_ip_not_private").alias("dst_external"),
                     F.col("network_direction").alias("direction"))


@query("ingest_dns", f"""
SELECT 'H' || event_id AS host_name, {EPOCH} AS ts_s, 'x.example.net' AS question,
  event_id AS network_bytes, 'dns-query' AS event_action,
  CASE WHEN event_id % 2 = 0 THEN 'nxdomain' ELSE '' END AS tags FROM events""")
def ingest_dns(spark, sf):
    """Tab-separated DNS export with its tag derivation."""
    ev = good_events(parse_lines(dns_lines(events(spark, sf)), SOURCES["dns"], "dns", DNS_HEADER))
    return ev.select("host_name", secs("ts").alias("ts_s"), F.col("dns_question_name").alias("question"),
                     "network_bytes", "event_action", F.array_join("tags", ",").alias("tags"))


def _all_sources(spark, sf):
    e = events(spark, sf)
    parts = [parse_lines(json_lines(e), SOURCES["auth"], "auth"),
             parse_lines(apache_lines(e), SOURCES["web"], "web"),
             parse_lines(syslog_lines(e), {**SOURCES["ssh"], "year": 2024}, "ssh"),
             parse_lines(csv_lines(e), SOURCES["firewall"], "firewall", FW_HEADER)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("ingest_loss", """
SELECT * FROM (
 SELECT 'auth' AS source, count(*) AS lines, count(*) FILTER (event_id % 50 > 3) AS parsed,
   count(*) FILTER (event_id % 50 IN (0, 1, 3)) AS parse_errors FROM events
 UNION ALL SELECT 'web', count(*), count(*) FILTER (event_id % 40 <> 0),
   count(*) FILTER (event_id % 40 = 0) FROM events
 UNION ALL SELECT 'ssh', count(*), count(*) FILTER (event_id % 30 <> 0),
   count(*) FILTER (event_id % 30 = 0) FROM events
 UNION ALL SELECT 'firewall', count(*), count(*) FILTER (event_id % 20 <> 0),
   count(*) FILTER (event_id % 20 = 0) FROM events)""")
def loss(spark, sf):
    """Four sources in one stream; lines, parsed and lost per source."""
    return ingest_loss(_all_sources(spark, sf)).select("source", "lines", "parsed", "parse_errors")


@query("ingest_error_kinds", """
SELECT source, error, n FROM (
 SELECT 'auth' AS source, CASE event_id % 50 WHEN 0 THEN 'bad json' WHEN 1 THEN 'json not an object'
   ELSE 'unreadable timestamp' END AS error, count(*) AS n FROM events
   WHERE event_id % 50 IN (0, 1, 3) GROUP BY 1, 2
 UNION ALL SELECT 'web', 'apache line shape', count(*) FROM events WHERE event_id % 40 = 0
 UNION ALL SELECT 'ssh', 'syslog line shape', count(*) FROM events WHERE event_id % 30 = 0
 UNION ALL SELECT 'firewall', 'csv field count', count(*) FROM events WHERE event_id % 20 = 0)
WHERE n > 0""")
def kinds(spark, sf):
    """Why lines were rejected."""
    return error_kinds(_all_sources(spark, sf))


@query("timestamp_formats", f"""
SELECT event_id, CASE event_id % 9 WHEN 8 THEN NULL WHEN 1 THEN {EPOCH} - 19800
  ELSE {EPOCH} END AS ts_s FROM events""")
def timestamps(spark, sf):
    """Every accepted timestamp shape, plus one that is not."""
    e = events(spark, sf)
    f = lambda p: F.date_format("ts", p)
    shapes = [f("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0530")),
              f("yyyy-MM-dd HH:mm:ss.SSS"), f("yyyy-MM-dd HH:mm:ss"), f("yyyy-MM-dd'T'HH:mm:ss"),
              F.concat(F.lit("Mon, "), f("dd MMM yyyy HH:mm:ss"), F.lit(" +0000")),
              F.concat(f("dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000")),
              F.concat(F.lit("x ["), f("dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0530]")),
              f("yyyy/MM/dd HH:mm")]
    text = F.array(*shapes)[(F.col("event_id") % 9).cast("int")]
    return e.select("event_id", secs(parse_timestamp(text)).alias("ts_s"))


@query("schema_conformance", """
SELECT event_id AS event_seq, CAST(65 AS BIGINT) AS columns_total,
  CAST(0 AS BIGINT) AS invented FROM events""")
def conformance(spark, sf):
    """Any frame conforms to the canonical schema: missing columns appear as nulls (I8)."""
    df = conform(events(spark, sf).select("event_seq", "ts", F.col("event_type").alias("event_action")))
    given = {"event_seq", "ts", "event_action"}
    rest = [c for c in df.columns if c not in given]
    invented = sum((F.col(c).isNotNull().cast("bigint") for c in rest), F.lit(0).cast("bigint"))
    canonical = len(df.columns) - 5     # source, event_seq, extra, vendor and lists are bookkeeping
    return df.select("event_seq", F.lit(canonical).cast("bigint").alias("columns_total"),
                     invented.alias("invented"))


@query("vendor_values", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a' WHEN event_id % 3 = 1 THEN 'u' || user_id END AS filled,
  CASE WHEN event_id % 2 = 0 THEN lower(event_type) || '.exe' ELSE 'Tool.EXE' END AS process
FROM events""")
def vendor_values(spark, sf):
    """Placeholders are no values; paths shrink to a lower-case name, bare names stay."""
    m = F.col("event_id") % 3
    first = F.when(m == 0, "a").when(m == 1, "-").otherwise("(null)")
    second = F.when(m == 1, F.concat(F.lit("u"), _s("user_id"))).otherwise("N/A")
    path = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("C:\\Dir/"), F.upper("event_type"), F.lit(".EXE\\"))
                  ).otherwise("Tool.EXE")
    return events(spark, sf).select("event_id", first_of(first, second).alias("filled"),
                                    basename_if_path(path).alias("process"))


@query("event_id_families", """
SELECT 'H' || event_id AS host_name,
  CASE event_id % 7 WHEN 0 THEN 'process-create' WHEN 1 THEN 'process-access' WHEN 2 THEN 'file-create'
    WHEN 3 THEN 'file-delete' WHEN 4 THEN 'registry-set-value' WHEN 5 THEN 'successful-logon' END AS event_action,
  CASE event_id % 7 WHEN 0 THEN 'process_creation' WHEN 1 THEN 'process_access' WHEN 2 THEN 'file_event'
    WHEN 3 THEN 'file_event' WHEN 4 THEN 'registry' WHEN 5 THEN 'authentication' ELSE 'other' END AS event_dataset,
  CASE event_id % 7 WHEN 0 THEN 'p.exe' WHEN 1 THEN 's.exe' WHEN 6 THEN 'n.exe' END AS process_name,
  CASE event_id % 7 WHEN 0 THEN 'eventcode/1,sysmon/1,process-create'
    WHEN 1 THEN 'eventcode/10,sysmon/10,process-access,access-to-process'
    WHEN 2 THEN 'eventcode/11,file-event,file-create' WHEN 3 THEN 'eventcode/23,file-event,file-delete'
    WHEN 4 THEN 'eventcode/13,sysmon/13,registry-event,registry-set-value'
    WHEN 5 THEN 'eventcode/4732' ELSE 'process-create' END AS tags,
  CASE WHEN event_id % 7 IN (2, 3) THEN 'c:\\dir\\f' || event_id || '.txt' END AS file_path,
  CASE WHEN event_id % 7 = 4 THEN 'hklm\\run' END AS registry_key,
  CASE WHEN event_id % 7 = 1 THEN '0x1010' END AS access_mask
FROM events""")
def families(spark, sf):
    """Event ids and endpoint families: actions, datasets, tags, nested objects."""
    e = events(spark, sf)
    bodies = ['"EventID":1,"event.dataset":"process_creation","Image":"C:\\\\\\\\x\\\\\\\\P.exe"',
              '"EventID":10,"event.dataset":"process_access","SourceImage":"C:/x/S.exe","TargetImage":"l.exe","GrantedAccess":"0X1010"',
              '"EventID":11,"event.dataset":"file_create","TargetFilename":"C:\\\\\\\\Dir\\\\\\\\F@.txt"',
              '"EventID":"23","event.dataset":"file_event","TargetFilename":"C:\\\\\\\\Dir\\\\\\\\F@.txt"',
              '"EventID":13,"event.dataset":"sysmon_13","TargetObject":"HKLM\\\\\\\\Run","Details":"X"',
              '"EventID":4732,"event.dataset":"authentication"',
              '"event.dataset":"other","ProcessCreate":{"Image":"D:/N.exe","CommandLine":"Go"}']
    body = F.array(*[F.lit(b.replace("\\\\\\\\", "\\\\")) for b in bodies])[(F.col("event_id") % 7).cast("int")]
    line = F.concat(F.lit('{"@timestamp":"'), _iso(), F.lit('","Computer":"H'), _s("event_id"), F.lit('",'),
                    F.replace(body, F.lit("@"), _s("event_id")), F.lit("}"))
    ev = good_events(parse_lines(e.select(line.alias("value")), {"type": "jsonl", "source_type": "Sysmon"}, "x"))
    return ev.select("host_name", "event_action", "event_dataset", "process_name",
                     F.array_join("tags", ",").alias("tags"), "file_path", "registry_key", "access_mask")


@query("event_sink", f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS event_dataset, count(*) AS n,
  CAST(sum(event_id) AS BIGINT) AS id_sum FROM events WHERE event_type IN ('error', 'click') GROUP BY 1, 2""")
def sink(spark, sf):
    """Partitioned event table written and read back with folder pruning (I16)."""
    path = scratch_path(spark, "events-table")
    write_events(conform(events(spark, sf).withColumnRenamed("event_type", "event_dataset")), path)
    back = read_events(spark, path).filter(F.col("event_dataset").isin("error", "click"))
    return back.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_dataset").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_seq").alias("id_sum"))


_IPS_SQL = r"""ips AS (SELECT DISTINCT unnest(regexp_extract_all(text,
  '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) AS ip FROM documents),
num AS (SELECT ip, CASE WHEN list_max(list_transform(string_split(ip, '.'), lambda x: CAST(x AS INT))) <= 255
  AND len(list_filter(string_split(ip, '.'), lambda x: len(x) > 1 AND x LIKE '0%')) = 0 THEN
  CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
  + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) END AS n FROM ips)"""


def document_ips(spark, sf):
    d = table(spark, sf, "documents")
    found = F.regexp_extract_all("text", F.lit(r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"), F.lit(0))
    return d.select(F.explode(found).alias("ip")).distinct()


@query("ip_flags", "WITH " + _IPS_SQL + """ SELECT ip, n AS ip_number, CASE WHEN n IS NULL THEN NULL ELSE
 (n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3232235520 AND 3232301055
  OR n BETWEEN 2130706432 AND 2147483647 OR n BETWEEN 2851995648 AND 2852061183) END AS internal,
 n BETWEEN 167772160 AND 184549375 OR n BETWEEN 3221225984 AND 3221226239 AS in_two_nets FROM num""")
def ip_flags(spark, sf):
    """Addresses found in documents: number, internal flag, CIDR membership."""
    ip = F.col("ip")
    return document_ips(spark, sf).select("ip", ipv4_number(ip).alias("ip_number"),
                                          is_internal(ip).alias("internal"),
                                          in_networks(ip, ["10.0.0.0/8", "192.0.2.0/24"]).alias("in_two_nets"))


@query("geo_lpm", "WITH " + _IPS_SQL + """, addr AS (
 SELECT ip, n FROM num UNION SELECT DISTINCT '203.0.113.' || (user_id % 250),
   3405803776 + user_id % 250 FROM events
 UNION SELECT DISTINCT '10.9.' || (user_id % 250) || '.1', 168361985 + (user_id % 250) * 256 FROM events),
net(base, len, label) AS (VALUES (167772160, 8, 'Coimbatore, IN (corporate LAN)'),
 (1742265344, 24, 'Chennai, IN'), (1746679552, 24, 'Singapore, SG'), (765185280, 24, 'Frankfurt, DE (anonymizer)'),
 (3118228736, 24, 'Rotterdam, NL (anonymizer)'), (3405803776, 24, 'Johannesburg, ZA'),
 (3325256704, 24, 'Sao Paulo, BR'), (3221225984, 24, 'Ashburn US (bulletproof hosting)'),
 (225126912, 24, 'Redmond, US'))
SELECT a.ip, arg_max(net.label, net.len) AS label, max(net.len)::BIGINT AS prefix
FROM addr a LEFT JOIN net ON a.n BETWEEN net.base AND net.base + (1::BIGINT << (32 - net.len)) - 1
WHERE net.label IS NOT NULL GROUP BY a.ip""")
def geo_lpm(spark, sf):
    """Longest-prefix geolocation as an equi-join per prefix length."""
    e = table(spark, sf, "events")
    more = e.select(F.explode(F.array(
        F.concat(F.lit("203.0.113."), (F.col("user_id") % 250).cast("string")),
        F.concat(F.lit("10.9."), (F.col("user_id") % 250).cast("string"), F.lit(".1")))).alias("ip"))
    places = locate(document_ips(spark, sf).unionByName(more), geo_prefixes(spark))
    return (places.filter(F.col("lat").isNotNull())
            .select("ip", "label", F.when(F.col("category") == "private", 8).otherwise(24)
                    .cast("bigint").alias("prefix")))


_WIDE = """feed AS (SELECT DISTINCT 6 AS family, 20 + user_id % 100 AS len, (8193::HUGEINT * 65536 + 3512) * (1::HUGEINT << 96)
   + (user_id % 16)::HUGEINT * (1::HUGEINT << 80) + ((user_id * 37) % 4096)::HUGEINT * (1::HUGEINT << 64) AS net FROM events
 UNION SELECT DISTINCT 4, CAST(9 + user_id % 24 AS INT), (203::HUGEINT << 24) + ((user_id % 8)::HUGEINT << 16) + (((user_id * 11) % 256)::HUGEINT << 8) FROM events),
ranges AS (SELECT family, len, net - net % (1::HUGEINT << (CASE family WHEN 6 THEN 128 ELSE 32 END - len)) AS lo,
   (1::HUGEINT << (CASE family WHEN 6 THEN 128 ELSE 32 END - len)) AS width FROM feed WHERE len < CASE family WHEN 6 THEN 128 ELSE 33 END),
addr AS (SELECT event_id, 6 AS family, (8193::HUGEINT * 65536 + 3512) * (1::HUGEINT << 96) + (user_id % 16)::HUGEINT * (1::HUGEINT << 80)
   + ((user_id * 37) % 4096 + event_id % 3)::HUGEINT * (1::HUGEINT << 64) + event_id % 97 AS n FROM events
 UNION ALL SELECT event_id, 4, (203::HUGEINT << 24) + ((event_id % 8)::HUGEINT << 16) + (((user_id * 11) % 256)::HUGEINT << 8) + event_id % 256 FROM events)"""


@query("geo_ranges", "WITH " + _WIDE + """ SELECT a.event_id, CAST(a.family AS INT) AS family, CAST(max(r.len) AS INT) AS prefix FROM addr a JOIN ranges r
 ON r.family = a.family AND a.n >= r.lo AND a.n < r.lo + r.width GROUP BY 1, 2""")
def geo_ranges(spark, sf):
    """A feed of both address families with over a hundred prefix lengths: one bucketed equi-join."""
    e = spread(table(spark, sf, "events"))
    hexed = lambda c: F.lower(F.hex(c))
    u, i = F.col("user_id"), F.col("event_id")
    six, four = 20 + u % 100, 9 + u % 24
    wide = F.concat(F.lit("2001:db8:"), hexed(u % 16), F.lit(":"), hexed((u * 37) % 4096), F.lit("::/"), six.cast("string"))
    narrow = F.concat(F.lit("203."), (u % 8).cast("string"), F.lit("."), ((u * 11) % 256).cast("string"), F.lit(".0/"), four.cast("string"))
    none = lambda t: F.lit(None).cast(t)
    feed = e.select(F.explode(F.array(F.struct(wide.alias("cidr"), six.cast("int").alias("prefix_len")), F.struct(narrow.alias("cidr"), four.cast("int").alias("prefix_len"))))
                    .alias("r")).select("r.*").distinct().select("*", F.col("cidr").alias("label"), none("double").alias("lat"), none("double").alias("lon"), none("string").alias("category"))
    ip6 = F.concat(F.lit("2001:DB8:"), hexed(u % 16), F.lit(":"), hexed((u * 37) % 4096 + i % 3), F.lit("::"), hexed(i % 97))
    ip4 = F.concat_ws(".", F.lit("203"), (i % 8).cast("string"), ((u * 11) % 256).cast("string"), (i % 256).cast("string"))
    asked = e.select("event_id", F.explode(F.array(F.struct(F.lit(6).alias("family"), ip6.alias("ip")), F.struct(F.lit(4).alias("family"), ip4.alias("ip")))).alias("a")).select("event_id", "a.*")
    places = locate(asked.select("ip"), feed).filter("prefix_len IS NOT NULL")
    return asked.join(places, "ip").select("event_id", "family", F.col("prefix_len").alias("prefix"))
