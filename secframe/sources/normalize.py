"""Parsed vendor records -> canonical events: aliases, values, flags, families."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from secframe import schema as S
from secframe.functions.net import is_internal
from secframe.functions.timeparse import parse_timestamp
from secframe.functions.values import any_of, basename, basename_if_path, clean, first_of, to_long
from secframe.sources.lines import last_wins, raw_field, timestamp_text

_NESTED = "struct<ParentImage:string,Image:string,CommandLine:string>"


def _lookup(mapping: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def _tags(raw_tags: Column) -> Column:
    listed = F.from_json(F.when(raw_tags.startswith("["), raw_tags), "array<string>")
    return F.coalesce(listed, F.when(clean(raw_tags).isNotNull(), F.array(raw_tags)),
                      F.array().cast("array<string>"))


def _aliased(df: DataFrame, source_type: str, aliases=None) -> DataFrame:
    """First usable vendor value per canonical field; values already canonical come first."""
    get = raw_field(df)
    vendors = {}
    for vendor, field in (S.ALIASES.get(source_type, []) if aliases is None else aliases):
        vendors.setdefault(field, []).append(vendor)
    out = {}
    for field in S.FIELDS:
        name = S.column_name(field)
        if field in ("@timestamp", "tags"):
            continue
        cands = [F.col(name).cast("string")] if name in df.columns else []
        cands += [c for c in map(get, [field, *vendors.get(field, [])]) if c is not None]
        if "lists" in df.columns:
            cands = [F.when(c != "[]", c) for c in cands]
        out[name] = first_of(*cands) if cands else F.lit(None).cast("string")
    if "tags" in df.columns:
        out["tags"] = F.col("tags")
    else:
        listed = get("tags")
        out["tags"] = _tags(listed) if listed is not None else F.array().cast("array<string>")
    keep = [c for c in ("ts", "source", "event_seq", "raw", "extra", "vendor", "_error", "_rejected", "_blank", "_pos")
            if c in df.columns]
    if "lists" in df.columns:       # items of a vendor's list belong to the field it fills
        moved = {v: f for f, vs in vendors.items() for v in vs}
        name = lambda k: F.coalesce(_lookup(moved, k), k) if moved else k
        out["lists"] = F.when(F.col("lists").isNotNull(), last_wins(F.transform(F.map_entries("lists"), lambda e: F.struct(
            name(e["key"]).alias("key"), e["value"].alias("value")))))
    return df.select(*keep, *[e.alias(n) for n, e in out.items()])


def _values(df: DataFrame) -> DataFrame:
    changed = {S.column_name(f): basename_if_path(F.col(S.column_name(f))) for f in S.BASENAMES}
    changed.update({S.column_name(f): F.lower(F.col(S.column_name(f))) for f in S.LOWERED})
    for f in S.LONG_FIELDS:
        changed[S.column_name(f)] = to_long(F.col(S.column_name(f)))
    for f in S.FLAG_FIELDS:
        changed[S.column_name(f)] = F.col(S.column_name(f)).try_cast("boolean")
    ds = F.lower(F.col("event_dataset"))
    changed["event_dataset"] = F.coalesce(_lookup(S.DATASET_ALIASES, ds), F.col("event_dataset"))
    return df.withColumns(changed)


def _families(df: DataFrame, source_type: str) -> DataFrame:
    """Event-id and family rules; every fill only touches empty fields."""
    get = raw_field(df)
    none = F.lit(None).cast("string")
    field = lambda k: none if get(k) is None else get(k)
    raw = lambda k: clean(field(k))
    c = F.col
    eid = F.trim(field("EventID")).try_cast("int")
    df = df.withColumns({"_eid": eid, "_ds": F.coalesce(F.lower(c("event_dataset")), F.lit(""))})
    eid, ds = c("_eid"), c("_ds")
    is_ds = lambda *names: ds.isin(list(names))
    is_id = lambda *ids: F.coalesce(eid.isin(list(ids)), F.lit(False))

    create = is_id(1) | is_ds("process_creation")
    access = is_id(10) | is_ds("process_access")
    file_ev = is_id(11, 23, 26) | is_ds("file_event")
    registry = is_id(13) | is_ds("registry")
    web = is_ds("web", "proxy") if source_type != "Apache" else F.lit(True)
    proxy = is_ds("proxy") if source_type != "Proxy" else F.lit(True)
    dns = is_ds("dns") if source_type != "DNS" else F.lit(True)
    firewall = is_ds("firewall") if source_type != "Firewall" else F.lit(True)
    ssh = is_ds("auth") if source_type != "SSH" else F.lit(True)
    nested = F.from_json(field("ProcessCreate"), _NESTED)
    nest = lambda f: clean(nested[f])
    has_nested = nested.isNotNull()

    auth_outcome = F.when(is_ds("authentication"), _lookup(S.AUTH_OUTCOME, eid))
    auth_action = F.when(auth_outcome == "success", "successful-logon").when(
        auth_outcome.isNotNull(), "failed-logon")
    outcome = F.coalesce(c("event_outcome"), auth_outcome,
                         F.when(web & c("http_response_status_code").isin(401, 403), "failure"))
    outcome = F.when(ssh, F.lower(outcome)).otherwise(outcome)
    action = F.coalesce(
        c("event_action"), auth_action, F.when(create, "process-create"),
        F.when(access, "process-access"),
        F.when(file_ev, F.when(is_id(23), "file-delete").otherwise("file-create")),
        F.when(registry, "registry-set-value"), F.when(web, "http-request"),
        F.when(dns, "dns-query"), F.when(firewall, "firewall-event"),
        F.when(ssh & outcome.isNotNull(), F.when(outcome == "failure", "authentication-failure")
               .otherwise("authentication-success")))
    action = F.when(firewall, F.lower(action)).otherwise(action)
    image = F.coalesce(raw("SourceImage"), raw("Image"))
    deleted = is_id(23)
    tag = lambda cond, *names: [F.when(cond, n) for n in names]
    more = F.array_compact(F.array(
        F.when(eid.isNotNull(), F.concat(F.lit("eventcode/"), eid.cast("string"))),
        *tag(create, "sysmon/1", "process-create"),
        *tag(access, "sysmon/10", "process-access", "access-to-process"),
        *tag(file_ev, "file-event"), *tag(file_ev & ~deleted, "file-create"),
        *tag(file_ev & deleted, "file-delete"),
        *tag(registry, "sysmon/13", "registry-event", "registry-set-value"),
        *tag(has_nested, "process-create"), *tag(web, "web-request"),
        *tag(dns & F.upper(c("dns_rcode")).contains("NXDOMAIN"), "nxdomain")))
    out = {
        "event_id": F.coalesce(c("event_id"), eid.cast("string")),
        "event_outcome": outcome, "event_action": action,
        "event_dataset": F.coalesce(
            c("event_dataset"), _lookup(S.DATASET_BY_EVENT_ID, eid), F.when(dns, "dns"),
            F.when(firewall, "firewall"), F.when(ssh, "auth")),
        "process_name": F.coalesce(c("process_name"), F.when(create, basename(raw("Image"))),
                                   F.when(access, basename(image)), basename(nest("Image"))),
        "process_parent": F.coalesce(c("process_parent"),
                                     F.when(create, basename(raw("ParentImage"))),
                                     basename(nest("ParentImage"))),
        "process_command_line": F.lower(F.coalesce(
            c("process_command_line"), F.when(create, raw("CommandLine")), nest("CommandLine"))),
        "target_process": F.coalesce(c("target_process"),
                                     F.when(access, basename(raw("TargetImage")))),
        "access_mask": F.coalesce(c("access_mask"), F.when(access, F.lower(raw("GrantedAccess")))),
        "file_path": F.coalesce(c("file_path"), F.when(file_ev, F.lower(raw("TargetFilename")))),
        "file_name": F.coalesce(c("file_name"), F.when(file_ev, basename(raw("TargetFilename")))),
        "registry_key": F.coalesce(c("registry_key"),
                                   F.when(registry, F.lower(raw("TargetObject")))),
        "registry_value": F.coalesce(c("registry_value"),
                                     F.when(registry, F.lower(raw("Details")))),
        "network_direction": F.coalesce(c("network_direction"),
                                        F.when((web & proxy) | dns | firewall, "outbound")),
        "web_auth_failure": F.coalesce(c("web_auth_failure"),
                                       F.when(web & c("url_path").contains("auth"), F.lit(True))),
        "source_ip_not_private": F.when(c("source_ip").isNotNull(), ~is_internal(c("source_ip"))),
        "destination_ip_not_private": F.when(c("destination_ip").isNotNull(),
                                             ~is_internal(c("destination_ip"))),
        "tags": F.array_union("tags", more),
    }
    df = df.withColumns(out)
    known = lambda f, *actions: F.coalesce(c(f), F.when(c("event_action").isin(list(actions)), True))
    return df.withColumns({
        "logon_failure": known("logon_failure", "failed-logon", "authentication-failure"),
        "logon_success": known("logon_success", "successful-logon", "authentication-success")})


def conform(df: DataFrame) -> DataFrame:
    """Every canonical column, in order and typed; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType)
                       .alias(f.name) for f in S.EVENT_SCHEMA.fields],
                     *[c for c in ("_error", "_rejected", "_blank", "_pos") if c in have])


def evaluated_once(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, so that filters above stay above.

    Pushed below, a test on ``_error`` would drag the whole parse into the filter and repeat it
    for every column mentioned.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def normalize(parsed: DataFrame, source_type: str, source: str | None = None, year: int = 2026,
              offset: str = "+00:00", aliases=None) -> DataFrame:
    """Parsed lines -> canonical events plus ``_error`` / ``_blank`` bookkeeping.

    A record whose timestamp cannot be read is an error too.  ``year`` and ``offset`` apply to
    sources whose timestamps lack them.
    """
    expect = {"Apache": "apache", "SSH": "syslog"}.get(source_type)
    df = parsed.withColumn("ts", parse_timestamp(timestamp_text(parsed), year, offset, expect))
    df = df.withColumn("_error", F.coalesce(F.col("_error"), F.when(
        ~F.col("_blank") & F.col("ts").isNull(), "unreadable timestamp")))
    if source is not None:
        df = df.withColumn("source", F.lit(source))
    df = evaluated_once(df.select(*[c for c in df.columns if c not in ("value", "_line", "_ts")]))
    return conform(_families(_values(_aliased(df, source_type, aliases)), source_type))
