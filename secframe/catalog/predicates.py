"""One query per rule predicate; each runs the compiled condition over a whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from secframe.catalog.base import CAPTURE_SQL, capture, events, query, table
from secframe.functions.match import Fields, compile_condition
from secframe.plans.rules import Rule

CAP = "WITH " + CAPTURE_SQL


def matching(df: DataFrame, condition, lowercased=()) -> DataFrame:
    return df.filter(compile_condition(condition, Fields(df, lowercased)))


@query("pred_equals", "SELECT event_id FROM events WHERE event_type IN ('error', 'purchase')")
def equals(spark, sf):
    """Case-insensitive equality and IN; a lower-case column keeps its pushdown."""
    return matching(events(spark, sf), [{"event_type": ["ERROR", "Purchase"]}],
                    lowercased={"event_type"}).select("event_id")


@query("pred_exists", CAP + " SELECT event_seq FROM cap WHERE host_name IS NOT NULL AND url_path IS NULL")
def exists(spark, sf):
    """Presence and absence."""
    return matching(capture(spark, sf), [{"host.name:exists": True, "url.path": {"exists": False}}]
                    ).select("event_seq")


@query("pred_regex", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\b[0-9]{3}-[0-9]{4}\b|password')")
def regex(spark, sf):
    """Unanchored search over whole texts."""
    return matching(table(spark, sf, "documents"),
                    [{"text": {"regex": r"\b[0-9]{3}-[0-9]{4}\b|password"}}]).select("doc_id")


@query("pred_wildcard", "SELECT page_id FROM pages WHERE lower(url) LIKE 'https://%/en/%' OR lower(url) LIKE '%page=1%'")
def wildcard(spark, sf):
    """Anchored, case-insensitive, only * is special."""
    return matching(table(spark, sf, "pages"), [{"url": {"wildcard": ["HTTPS://*/en/*", "*page=1*"]}}]
                    ).select("page_id")


@query("pred_cidr", CAP + " SELECT event_seq FROM cap WHERE source_ip LIKE '10.10.%' OR source_ip LIKE '203.0.113.%'")
def cidr(spark, sf):
    """P5: address in any of several networks; broken blocks are ignored."""
    return matching(capture(spark, sf),
                    [{"source.ip": {"cidr": ["10.10.0.0/16", "203.0.113.0/24", "nonsense"]}}]
                    ).select("event_seq")


def _tagged(spark, sf):
    e = events(spark, sf)
    return e.select("event_id", F.array_compact(F.array(
        F.when(F.col("user_id") % 2 == 0, "even"), F.when(F.col("user_id") % 3 == 0, "third"),
        "event_type")).alias("tags"), F.array(F.upper("event_type"), F.lit("Any")).alias("kinds"))


@query("pred_all", "SELECT event_id FROM events WHERE user_id % 6 = 0")
def contains_all(spark, sf):
    """A list holding every operand."""
    return matching(_tagged(spark, sf), [{"tags_list": {"all": ["x"]}}, {"kinds": {"all": ["Any", "zz"]}},
                                         {"kinds": {"all": ["Any"]}, "tags": ["even"], "@all": [
                                             {"tags": ["third"]}]}]).select("event_id")


@query("pred_numeric", "SELECT event_id FROM events WHERE value >= 12.5 AND value < 40 AND event_id > 20")
def numeric(spark, sf):
    """Gt, gte, lt, lte; text that is no number never matches."""
    return matching(events(spark, sf), [{"value": {"gte": 12.5, "lt": "40"}, "event_id": {"gt": 20}},
                                        {"event_type": {"gte": 0}}]).select("event_id")


@query("pred_equals_op", CAP + " SELECT event_seq FROM cap WHERE lower(host_name) = 'dc-01'")
def equals_operator(spark, sf):
    """The explicit equals operator; null equals nothing, not even 'none'."""
    return matching(capture(spark, sf), [{"host.name": {"equals": "dc-01"}}, {"host.name": {"equals": "none"}}]
                    ).select("event_seq")


@query("pred_boolean", CAP + " SELECT event_seq FROM cap WHERE NOT (source_ip LIKE '10.%')")
def boolean(spark, sf):
    """Boolean literals test the truth of the field."""
    return matching(capture(spark, sf), [{"source.ip_not_private": True}]).select("event_seq")


@query("pred_list_field", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def list_field(spark, sf):
    """P10: a list-valued field matches when any element does."""
    return matching(_tagged(spark, sf), [{"kinds": ["Click", "VIEW"]}]).select("event_id")


@query("pred_tags", "SELECT event_id FROM events WHERE user_id % 3 = 0 OR event_type = 'error'")
def tags(spark, sf):
    """Any tag present, case-sensitive."""
    return matching(_tagged(spark, sf), [{"tags": ["third", "error", "EVEN"]}]).select("event_id")


@query("pred_nested", CAP + """ SELECT event_seq FROM cap WHERE (process_name = 'powershell.exe'
  OR network_bytes >= 100000000) AND source_ip NOT LIKE '10.%' AND user_name LIKE 'user1%'""")
def nested(spark, sf):
    """Nested any-of and all-of groups."""
    return matching(capture(spark, sf), [{
        "@any_of": [{"process.name": "powershell.exe"}, {"network.bytes": {"gte": 100000000}}],
        "@all": [{"source.ip_not_private": True}, {"user.name": {"wildcard": "user1*"}}]}]).select("event_seq")


@query("pred_filter", CAP + """ SELECT event_seq FROM cap WHERE event_action IN ('failed-logon', 'deny')
  AND source_ip <> '203.0.113.77' AND coalesce(host_name, '') NOT LIKE 'SRV-%'""")
def filters(spark, sf):
    """OR of groups, minus anything a filter group matches (null never filters)."""
    df = capture(spark, sf)
    rule = Rule.of({"id": "x", "condition": [{"event.action": "failed-logon"}, {"event.action": "deny"}],
                    "filter": [{"source.ip": ["203.0.113.77"]}, {"host.name": {"wildcard": "srv-*"}}]})
    return df.filter(rule.hit(Fields(df))).select("event_seq")


@query("pred_dataset", CAP + " SELECT event_seq FROM cap WHERE event_dataset IN ('web', 'proxy') AND process_name = 'svcmon.exe'")
def dataset(spark, sf):
    """Dataset scope."""
    df = capture(spark, sf)
    rule = Rule.of({"id": "x", "logsource": {"dataset": ["web", "proxy"]}, "condition": {"process.name": "svcmon.exe"}})
    return df.filter(rule.hit(Fields(df))).select("event_seq")


@query("pred_multi_operator", CAP + """ SELECT event_seq FROM cap WHERE destination_port > 430 AND destination_port <= 460
  AND CAST(destination_port AS VARCHAR) LIKE '%5'""")
def multi_operator(spark, sf):
    """Several operators on one field must all hold."""
    return matching(capture(spark, sf), [{"destination.port": {
        "gt": 430, "lte": 460, "regex": "5$", "exists": True}}]).select("event_seq")
