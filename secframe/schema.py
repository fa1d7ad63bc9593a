"""Canonical event vocabulary and vendor alias tables."""
from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: canonical dotted field names -------------------------------------------
FIELDS = """
@timestamp event.dataset event.action event.outcome event.kind event.id event.original
host.name host.ip host.criticality user.name user.domain
source.ip source.port source.host source.mac
destination.ip destination.port destination.domain destination.nat.ip
url.path url.domain url.full http.request.method http.response.status_code
network.bytes bytes_sent network.direction network.transport network.packets
process.name process.parent process.command_line process.pid process.hash
process.image_raw process.access_mask access_mask target.process
file.path file.name file.hash file.size file.new_contents
registry.key registry.value dns.question.name dns.rcode dns.answer query_type answer
auth.method auth.mfa firewall.rule firewall.action file_count file_bytes file_total
source.ip_not_private destination.ip_not_private logon.failure logon.success
web_auth_failure tags rule.name
""".split()

LONG_FIELDS = {
    "source.port", "destination.port", "http.response.status_code", "network.bytes", "bytes_sent",
    "network.packets", "process.pid", "file.size", "file_count", "file_bytes", "file_total",
}
FLAG_FIELDS = {
    "source.ip_not_private", "destination.ip_not_private", "logon.failure", "logon.success",
    "web_auth_failure",
}
# fields stored lower-case by ingest, so equality on them needs no lower() and can be pushed down
LOWERCASED = {
    "file_path", "registry_key", "registry_value", "access_mask", "url_path",
    "dns_question_name", "destination_domain", "process_command_line",
}
BASENAMES = ("process.name", "process.parent", "target.process")
LOWERED = ("file.path", "registry.key", "registry.value", "access_mask", "url.path",
           "dns.question.name", "destination.domain", "process.command_line")

# ---- fixed values: vendor column -> canonical field, in fill order -------------------------
ALIASES = {
    "Sysmon": [
        ("Computer", "host.name"), ("SourceComputerName", "host.name"), ("HostName", "host.name"),
        ("TargetUserName", "user.name"), ("User", "user.name"), ("Account", "user.name"),
        ("IpAddress", "source.ip"), ("SourceIp", "source.ip"), ("ClientIP", "source.ip"),
        ("Workstation", "source.host"),
        ("Image", "process.name"), ("ProcessName", "process.name"),
        ("ParentImage", "process.parent"), ("CommandLine", "process.command_line"),
        ("TargetFilename", "file.path"), ("TargetObject", "registry.key"),
        ("Details", "registry.value"), ("GrantedAccess", "access_mask"),
        ("TargetImage", "target.process"), ("DestinationIp", "destination.ip"),
        ("DestinationPort", "destination.port"), ("DestinationHostname", "destination.domain"),
        ("QueryName", "dns.question.name"), ("Initiated", "network.direction"),
        ("NewFileContents", "file.new_contents"), ("Process", "process.image_raw"),
    ],
    "Apache": [("client_ip", "source.ip"), ("bytes", "network.bytes"),
               ("status", "http.response.status_code"), ("cs-username", "user.name")],
    "Firewall": [("ts", "@timestamp"), ("action", "event.action"), ("src_ip", "source.ip"),
                 ("src_port", "source.port"), ("dst_ip", "destination.ip"),
                 ("dst_port", "destination.port"), ("bytes", "network.bytes"),
                 ("proto", "network.transport"), ("rule", "firewall.rule"),
                 ("host", "host.name"), ("dst_domain", "destination.domain"),
                 ("user", "user.name")],
    "DNS": [("ts", "@timestamp"), ("client_ip", "source.ip"), ("host", "host.name"),
            ("query", "dns.question.name"), ("type", "query_type"),
            ("response_bytes", "network.bytes"), ("rcode", "dns.rcode"), ("answer", "answer")],
    "Proxy": [],
    "SSH": [("action", "event.action"), ("ip", "source.ip"), ("user", "user.name"),
            ("rport", "source.port"), ("host", "host.name"), ("method", "auth.method"),
            ("outcome", "event.outcome")],
}
PLACEHOLDERS = ["", "-", "N/A", "n/a", "None", "null", "(null)"]

# ---- fixed values: Windows / Sysmon event ids ----------------------------------------------
AUTH_OUTCOME = {4624: "success", 4625: "failure", 4648: "success", 4672: "success",
                4688: "success", 4720: "success", 4732: "success", 4768: "failure",
                4771: "failure", 1102: "success"}
DATASET_BY_EVENT_ID = {1: "process_creation", 3: "network_connection", 10: "process_access",
                       11: "file_event", 13: "registry", 23: "file_event", 26: "file_event",
                       1102: "log_clearing", 4688: "process_creation"}
# vendor dataset names that must not leak into rules
DATASET_ALIASES = {"sysmon_13": "registry", "file_create": "file_event"}


def column_name(field: str) -> str:
    """Dotted canonical name -> Spark column name (``@timestamp`` -> ``ts``)."""
    return "ts" if field == "@timestamp" else field.replace(".", "_")


def column_type(field: str) -> T.DataType:
    if field == "@timestamp":
        return T.TimestampType()
    if field in LONG_FIELDS:
        return T.LongType()
    if field in FLAG_FIELDS:
        return T.BooleanType()
    if field == "tags":
        return T.ArrayType(T.StringType())
    return T.StringType()


EVENT_SCHEMA = T.StructType(
    [T.StructField(column_name(f), column_type(f)) for f in FIELDS]
    + [T.StructField("source", T.StringType()), T.StructField("event_seq", T.LongType()),
       T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
       # vendor fields that filled a canonical one, and the items of list-valued fields
       T.StructField("vendor", T.MapType(T.StringType(), T.StringType())),
       T.StructField("lists", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])
COLUMNS = [f.name for f in EVENT_SCHEMA]
BY_COLUMN = {column_name(f): f for f in FIELDS}
