"""Alerts -> incidents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from secframe.functions.net import is_internal
from secframe.functions.values import floor_div, micros
from secframe.operators.alerts import listed_values
from secframe.operators.components import connected_components
from secframe.operators.enrich import entity, level
from secframe.operators.skew import first_k, global_rank, previous_in_order, time_slices
from secframe.plans import settings as cfg
from secframe.session import materialize

STRONG = ["user_name", "host_name"]
WEAK = ["source_ip", "destination_domain", "destination_ip", "process_name"]
# what an incident row shows by default
ENTITY_VALUES, NOTES, TIMELINE_ROWS = 12, 6, 14
HOUR = 3_600_000_000


def dedup_parts(alerts: DataFrame, minutes: float | None = None, by_id: bool = False) -> DataFrame:
    """(akey, a, n_events, last, n): alerts folded by rule and first source, host, user and domain.

    ``a`` is the first alert as a struct.  Parts can be folded again (``merge_parts``), in any order.
    """
    lead = lambda k: F.get(entity(k), F.lit(0))
    keys = [F.col("rule_id"), lead("source_ip"), lead("host_name"), lead("user_name"), lead("destination_domain")]
    if minutes is not None:
        keys.append(floor_div(micros(F.col("first_seen")), int(minutes * 60_000_000)).cast("string"))
    akey = F.col("alert_id") if by_id else F.sha1(F.to_json(F.array(*keys)))
    whole = F.struct(*[F.col(c) for c in alerts.columns if c != "deduped_from"])
    return merge_parts(alerts.select(akey.alias("akey"), whole.alias("a"), F.col("count").alias("n_events"),
                                     F.col("last_seen").alias("last"), F.lit(1).cast("bigint").alias("n")))


def merge_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("akey").agg(
        F.min_by("a", F.struct("a.first_seen", "a.alert_id")).alias("a"), F.sum("n_events").alias("n_events"),
        F.max("last").alias("last"), F.sum("n").alias("n"))


def render_parts(parts: DataFrame) -> DataFrame:
    """Folded alerts as alert rows, with their ``akey``."""
    n = F.col("n")
    changed = {"count": F.col("n_events"), "last_seen": F.col("last"),
               "repeat_count": (F.col("a.repeat_count") + n - 1).cast("int"),
               "note": F.when(n > 1, F.concat_ws(" | ", F.when(F.col("a.note") != "", F.col("a.note")),
                                                 F.concat(F.lit("deduped x"), n.cast("string")))).otherwise(F.col("a.note"))}
    fields = parts.schema["a"].dataType.fieldNames()
    return parts.select("akey", *[changed.get(c, F.col(f"a.{c}")).alias(c) for c in fields],
                        F.when(n > 1, n).alias("deduped_from"))


def dedup_alerts(alerts: DataFrame, minutes: float | None = None) -> DataFrame:
    """Collapse repeats of a rule on the same first source, host, user and domain.

    Counts add up and ``last_seen`` extends; with ``minutes`` only repeats that start in the same
    window of that length (from the epoch) collapse.
    """
    return render_parts(dedup_parts(alerts, minutes)).drop("akey")


def correlation_keys(alerts: DataFrame, *keep: str) -> DataFrame:
    """Entity sets used for linking; internal source addresses are no link on their own."""
    sets = {k: F.array_distinct(F.coalesce(entity(k), F.array().cast("array<string>")))
            for k in STRONG + WEAK}
    sets["source_ip"] = F.filter(sets["source_ip"],
                                 lambda ip: ~F.coalesce(is_internal(ip), F.lit(False)))
    return alerts.select(*keep, "alert_id", "score", "first_seen", "last_seen",
                         F.struct(*[e.alias(k) for k, e in sets.items()]).alias("sets"))


def entity_rows(base: DataFrame, *keep: str) -> DataFrame:
    """One row per alert and entity value; the sets go along only where links depend on them."""
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("sets")[k].alias("values"))
                       for k in STRONG + WEAK])
    return (base.select("*", F.explode(listed).alias("e"))
            .select(*keep, "alert_id", "score", "first_seen", "last_seen",
                    F.when(~F.col("e.kind").isin(STRONG), F.col("sets")).alias("sets"),
                    F.col("e.kind").alias("kind"), F.explode("e.values").alias("value")))


def close_pairs(rows: DataFrame, span: int) -> DataFrame:
    """Rows whose predecessor ``prev`` is near enough and shares enough to be linked."""
    gap = F.abs(micros(F.col("last_seen")) - micros(F.col("prev.last_seen")))
    close = rows.filter(F.col("prev").isNotNull() & (gap <= span))
    return close.filter(F.col("kind").isin(STRONG) | (shared_kinds(F.col("sets"), F.col("prev.sets")) >= 2))


def shared_kinds(a: Column, b: Column) -> Column:
    """In how many entity kinds do two alerts overlap?"""
    total = F.lit(0)
    for k in STRONG + WEAK:
        total = total + F.when(F.arrays_overlap(a[k], b[k]), 1).otherwise(0)
    return total


def value_rows(alerts: DataFrame, values: DataFrame) -> DataFrame:
    """One row per alert and entity value from the long table of all values; no sets are held."""
    inside = (F.col("kind") == "source_ip") & F.coalesce(is_internal(F.col("value")), F.lit(False))
    wanted = values.filter(F.col("kind").isin(STRONG + WEAK) & ~inside).select("alert_id", "kind", "value").distinct()
    return alerts.select("alert_id", "score", "first_seen", "last_seen").join(wanted, "alert_id")


def share_two_kinds(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b) of the pairs that overlap in two entity kinds; the smaller alert's values are looked up in the larger one."""
    rows = rows.select("alert_id", "kind", "value")
    size = rows.groupBy("alert_id").agg(F.count(F.lit(1)).alias("n"))
    of = lambda side: size.select(F.col("alert_id").alias(side), F.col("n").alias(f"n_{side}"))
    sized = pairs.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    small = F.col("n_a") <= F.col("n_b")
    sized = sized.select("a", "b", F.when(small, F.col("a")).otherwise(F.col("b")).alias("alert_id"), F.when(small, F.col("b")).otherwise(F.col("a")).alias("other"))
    both = sized.join(rows, "alert_id").join(rows.withColumnRenamed("alert_id", "other"), ["other", "kind", "value"])
    return both.groupBy("a", "b").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi")).filter("lo < hi").select("a", "b")


def link_alerts(alerts: DataFrame, window_minutes: float = cfg.CORRELATION_MINUTES,
                order: str = "score", values: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between neighbouring alerts of an entity value.

    Strong keys (user, host) link on their own, weak ones only when at least two kinds overlap.
    Neighbours are taken in score order (``order="score"``) or by last activity
    (``order="time"``).  A value shared by very many alerts is never one group: score order looks
    back inside (value, score, hour) bins stitched at their ends, time order inside time slices.
    With ``values`` (the long table of all entity values) links do not depend on the lists that
    alert rows show.
    """
    keys, span = ["kind", "value"], int(window_minutes * 60_000_000)
    if values is not None:
        rows = materialize(value_rows(alerts, values), "alert-values")
        whole, me = rows, F.struct("alert_id", "last_seen")
    else:
        base = correlation_keys(alerts)
        if order == "score":        # read by three branches below
            base = materialize(base, "alert-keys")
        rows, me = entity_rows(base), F.struct("alert_id", "last_seen", "sets")
    if order == "score":
        rows = rows.withColumn("hour", floor_div(micros(F.col("first_seen")), HOUR))
        rows = previous_in_order(rows, keys, [("score", True), ("hour", False)],
                                 [F.col("first_seen"), F.col("alert_id")], me, "prev")
    elif order == "time":
        rows = time_slices(rows.withColumn("t", micros(F.col("last_seen"))), "t", back=span)
        w = Window.partitionBy(*keys, "slice").orderBy("t", "alert_id")
        rows = rows.withColumn("prev", F.lag(me).over(w)).filter("own")
    else:
        raise ValueError(f"unknown order {order!r}")
    ends = [F.least("alert_id", "prev.alert_id").alias("a"), F.greatest("alert_id", "prev.alert_id").alias("b"), "kind", "value"]
    if values is None:
        return close_pairs(rows, span).select(*ends)
    gap = F.abs(micros(F.col("last_seen")) - micros(F.col("prev.last_seen")))
    close = materialize(rows.filter(F.col("prev").isNotNull() & (gap <= span)).select(*ends), "close-pairs")
    weak = close.filter(~F.col("kind").isin(STRONG))
    return close.filter(F.col("kind").isin(STRONG)).unionByName(weak.join(share_two_kinds(weak, whole), ["a", "b"]))


def correlate(alerts: DataFrame, window_minutes: float = cfg.CORRELATION_MINUTES,
              order: str = "score", values: DataFrame | None = None) -> DataFrame:
    """(alert_id, component)."""
    edges = link_alerts(alerts, window_minutes, order, values)
    nodes = alerts.select(F.col("alert_id").alias("node"))
    return connected_components(edges.select("a", "b"), nodes).select(
        F.col("node").alias("alert_id"), "component")


# ---------------------------------------------------------------- incident pieces
def _ranked(values, c: Column) -> Column:
    """Position in a fixed list; unknown values sort last."""
    return F.coalesce(F.element_at(F.create_map(*[x for i, v in enumerate(values)
                                                  for x in (F.lit(v), F.lit(i))]), c), F.lit(99))


def worst_severity(severity: Column) -> Column:
    best = F.min(_ranked(cfg.SEVERITIES, severity))
    return F.get(F.array(*[F.lit(s) for s in cfg.SEVERITIES]), best)


def kill_chain(tactic: Column) -> Column:
    ordered = F.array_sort(F.collect_set(F.struct(
        _ranked(cfg.TACTIC_ORDER, tactic).alias("r"), tactic.alias("t"))))
    return F.transform(ordered, lambda x: x["t"])


def merged_values(grouped: DataFrame, by: str, values: DataFrame | None = None) -> DataFrame:
    """All entity values of groups of alerts with the first place of each: (by, kind, value, at)."""
    rows = (listed_values(grouped, by, "first_seen") if values is None
            else grouped.select(by, "first_seen", "alert_id").join(values, "alert_id"))
    return rows.groupBy(by, "kind", "value").agg(F.min(F.struct("first_seen", "alert_id", "pos")).alias("at"))


def merged_entities(grouped: DataFrame, by: str, keep: int = ENTITY_VALUES, values: DataFrame | None = None) -> DataFrame:
    """The first entity values per kind over a group of alerts, earliest alerts first."""
    return first_entities(merged_values(grouped, by, values), by, keep)


def first_entities(merged: DataFrame, by: str, keep: int = ENTITY_VALUES) -> DataFrame:
    """The same from merged values."""
    kept = first_k(merged, [by, "kind"], ["at", "value"], keep)
    lists = kept.groupBy(by, "kind").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("v"))
    return lists.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("kind", "v")))
                                 .alias("entities"))


def entity_prints(merged: DataFrame, by: str) -> DataFrame:
    """Number and order-free hash of all merged entity values of a group; nothing is listed."""
    return merged.groupBy(by).agg(F.count(F.lit(1)).alias("entity_count"), F.bit_xor(F.xxhash64("kind", "value")).alias("_x"),
                                F.bit_xor(F.xxhash64("value", "kind")).alias("_y")).select(
        by, "entity_count", F.concat_ws("-", F.hex("_x"), F.hex("_y")).alias("_print"))


def incident_timeline(grouped: DataFrame, by: str = "component", keep: int = TIMELINE_ROWS) -> DataFrame:
    """First alerts of each incident in time order and how many follow."""
    total = grouped.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    kept = first_k(grouped.select(by, "first_seen", "alert_id", "severity", "score", "rule_id",
                                  "rule_name", "technique"),
                   [by], ["first_seen", "alert_id"], keep)
    row = F.struct("rank", "first_seen", "severity", "score", "rule_id", "rule_name", "technique")
    rows = kept.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("events"))
    return rows.join(total, by).withColumn("further", F.col("total") - F.size("events"))


def priority(score: Column) -> Column:
    return level(score, cfg.PRIORITY_LEVELS, "P4")


def sla_due(severity: Column, opened: Column) -> Column:
    hours = F.element_at(F.create_map(*[x for s, h in cfg.SLA_HOURS.items()
                                        for x in (F.lit(s), F.lit(h))]), severity)
    return opened + F.make_interval(hours=hours)


def _short(name: Column) -> Column:
    return F.split_part(name, F.lit(" -"), F.lit(1))


def build_incidents(alerts: DataFrame, components: DataFrame, run_ts=None, values: DataFrame | None = None,
                    keep: int = ENTITY_VALUES, notes_kept: int = NOTES, timeline_rows: int = TIMELINE_ROWS, ranked: bool = True) -> DataFrame:
    """One row per component.  The three numbers say how much a row shows; ``entity_count`` and the
    fingerprint cover all entity values.  Without ``ranked`` there are no rank and case id."""
    grouped = materialize(alerts.join(components, "alert_id"), "grouped-alerts")
    at = F.struct("first_seen", "alert_id")
    stats = grouped.groupBy("component").agg(
        worst_severity(F.col("severity")).alias("severity"), F.max("score").alias("score"),
        F.min("first_seen").alias("opened_at"), F.max("last_seen").alias("last_activity"),
        F.count(F.lit(1)).alias("alert_count"), F.size(F.collect_set("rule_id")).cast("bigint").alias("rule_count"),
        F.array_sort(F.collect_set("rule_id")).alias("rules"),
        kill_chain(F.col("tactic")).alias("tactics"),
        F.min_by("rule_name", at).alias("_first_name"), F.max_by("rule_name", at).alias("_last_name"))
    skills = (grouped.select("component", F.explode("technique").alias("technique"))
              .groupBy("component").agg(F.array_sort(F.collect_set("technique")).alias("techniques")))
    noted = first_k(grouped.filter(F.coalesce("note", F.lit("")) != "")
                    .select("component", "first_seen", "alert_id", "note"),
                    ["component"], ["first_seen", "alert_id"], notes_kept)
    notes = noted.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", "note"))), lambda x: x["note"]).alias("triage_notes"))
    merged = materialize(merged_values(grouped, "component", values), "merged-values")
    entities = first_entities(merged, "component", keep).join(entity_prints(merged, "component"), "component")
    lines = incident_timeline(grouped, keep=timeline_rows).select("component", F.col("events").alias("timeline"),
                                              "further")
    out = stats
    for piece in (skills, notes, entities, lines):
        out = out.join(piece, "component", "left")
    empty = F.array().cast("array<string>")
    who = F.get(F.coalesce(entity("user_name"), entity("host_name"), entity("source_ip")), F.lit(0))
    n = F.col("alert_count")
    title = (F.when(n == 2, F.concat(F.lit("Campaign: "), _short(F.col("_first_name")), F.lit(" & "),
                                     _short(F.col("_last_name"))))
             .when(n > 2, F.concat(F.lit("Campaign: "), _short(F.col("_first_name")), F.lit(" + "),
                                   (n - 1).cast("string"), F.lit(" related")))
             .otherwise(F.concat_ws(" - ", F.col("_first_name"), who)))
    out = out.withColumns({
        "title": title, "techniques": F.coalesce("techniques", empty),
        "triage_notes": F.coalesce("triage_notes", empty),
        "chain": F.array_join("tactics", " -> "),
        "fingerprint": F.substring(F.sha1(F.concat_ws("|", F.array_join("rules", "|"), F.coalesce("_print", F.lit("")))), 1, 12),
        "entity_count": F.coalesce("entity_count", F.lit(0)).cast("bigint"),
        "recommended_priority": priority(F.col("score")),
        "sla_due": sla_due(F.col("severity"), F.col("opened_at")),
        "status": F.lit("new"), "assignee": F.lit(None).cast("string"),
        "closed_at": F.lit(None).cast("timestamp"),
        "_hour": floor_div(micros(F.col("opened_at")), HOUR)}).drop("_first_name", "_last_name", "_print")
    if not ranked:
        return out.drop("_hour")
    # ranking reads its input twice
    out = global_rank(materialize(out, "unranked"), [("score", True), ("_hour", False)],
                      [F.col("opened_at"), F.col("component")], "rank")
    day = F.date_format(F.col("last_activity") if run_ts is None else F.lit(run_ts).cast("timestamp"),
                        "yyyyMMdd")
    number = F.col("rank").cast("string")
    return out.withColumn("case_id", F.concat_ws("-", F.lit("INC"), day, F.when(
        F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))).drop("_hour")


def incidents(alerts: DataFrame, window_minutes: float = cfg.CORRELATION_MINUTES,
              order: str = "score", run_ts=None, values: DataFrame | None = None):
    """Deduplicated alerts -> (incidents, membership of alerts)."""
    components = materialize(correlate(alerts, window_minutes, order, values), "components")
    return build_incidents(alerts, components, run_ts, values), components
