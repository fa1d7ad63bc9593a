"""Events + rules -> alerts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from secframe.functions.values import micros
from secframe.operators import alerts as A
from secframe.operators.beacon import beacons, in_dense, instants_of
from secframe.operators.hits import literal_by_rule, rule_hits, with_evidence, EVIDENCE
from secframe.operators.sequence import fired_sequences, sequence_members, sequence_rows
from secframe.operators.threshold import origin_of, threshold_groups, tumbling_buckets
from secframe.operators.travel import first_moves
from secframe.plans.rules import load_rules, rules_frame
from secframe.plans.settings import geo_prefixes
from secframe.schema import LOWERCASED
from secframe.session import materialize

_MEMBER = ["alert_id", "rule_ix", "place", "t", "event_seq", *EVIDENCE]


def _members(df: DataFrame, **head) -> DataFrame:
    return df.select("alert_id", "rule_ix", F.col("place").cast("int").alias("place"), "t",
                     "event_seq", *[F.col(c).cast("string").alias(c) for c in EVIDENCE],
                     *A.head_columns(**head))


def threshold_members(hits: DataFrame, rules, origin: Column):
    bucketed = tumbling_buckets(hits, rules, origin)
    groups = threshold_groups(bucketed, rules)
    minutes = literal_by_rule([f"{r.span_micros('threshold') / 6e7:g}" if r.threshold else ""
                               for r in rules], "string")
    field = literal_by_rule([r.threshold.get("distinct_field", "") for r in rules], "string")
    note = F.when(field != "", F.format_string(
        "%d distinct %s values in %sm", F.col("distinct_count"), field, minutes)).otherwise("")
    keys = ["rule_ix", "key", "bucket"]
    picked = bucketed.join(groups.select(*keys, "distinct_count"), keys).withColumn(
        "alert_id", A.alert_id(A.rule_name_of(rules), F.lit("threshold"), F.col("key"), F.col("bucket")))
    return _members(picked.withColumn("place", F.lit(0)), note=note,
                    distinct_count=F.when(field != "", F.col("distinct_count")))


def sequence_alert_members(hits: DataFrame, rules):
    rows = sequence_rows(hits, rules)
    fired = fired_sequences(rows, rules)
    minutes = literal_by_rule([f"{r.span_micros('sequence') / 6e7:g}" if r.has_sequence else ""
                               for r in rules], "string")
    picked = sequence_members(rows, fired, rules).withColumn(
        "alert_id", A.alert_id(A.rule_name_of(rules), F.lit("sequence"), F.col("key"), F.col("fire_t")))
    return _members(picked, prior_events=F.col("prior_events"), note=F.format_string(
        "preceded by %d matching prior event(s) in %sm", F.col("prior_events"), minutes))


def travel_members(hits: DataFrame, rules, prefixes: DataFrame):
    moves = first_moves(hits, rules, prefixes)
    geo = F.struct(F.col("a.label").alias("from"), F.col("b.label").alias("to"),
                   F.bround("km").cast("bigint").alias("distance_km"),
                   F.bround("minutes", 1).alias("minutes"),
                   F.bround("kmh").cast("bigint").alias("required_speed_kmh"))
    note = F.format_string("impossible travel: %d km in %d min (needs %d km/h)",
                           F.bround("km").cast("bigint"), F.bround("minutes").cast("bigint"),
                           F.bround("kmh").cast("bigint"))
    ends = moves.select(
        "rule_ix", A.alert_id(A.rule_name_of(rules), F.lit("travel"), F.col("key"), F.col("a.t")).alias("alert_id"),
        geo.alias("geo"), note.alias("note"), F.posexplode(F.array("a", "b")).alias("place", "e"))
    return _members(ends.select("alert_id", "rule_ix", "place", "e.*", "geo", "note"),
                    geo=F.col("geo"), note=F.col("note"))


def beacon_members(hits: DataFrame, rules):
    found = beacons(hits, rules)
    spans = literal_by_rule([r.span_micros("beacon") if r.mode == "beacon" else 1 for r in rules],
                            "bigint")
    baseline = F.struct(F.bround("mean_s", 1).alias("interval_mean_s"),
                        F.bround("sd_s", 1).alias("interval_stdev_s"),
                        F.bround("cov", 4).alias("cov"),
                        F.col("in_window").alias("events_in_window"))
    note = F.format_string("machine-regular polling: %d events, mean interval %ds, CoV %s",
                           F.col("in_window"), F.bround("mean_s").cast("bigint"),
                           F.bround("cov", 3).cast("string"))
    found = found.select("rule_ix", "key", "window_end", baseline.alias("baseline"), note.alias("note"))
    picked = (in_dense(instants_of(hits, rules), found, ["rule_ix", "key"], spans)
              .withColumn("alert_id", A.alert_id(A.rule_name_of(rules), F.lit("beacon"), F.col("key"), F.col("window_end")))
              .withColumn("place", F.lit(0)))
    return _members(picked, baseline=F.col("baseline"), note=F.col("note"))


def detect(events: DataFrame, rules, origin=None, prefixes: DataFrame | None = None,
           lowercased=LOWERCASED, fold: bool = True, shown: A.Shown = A.SHOWN) -> DataFrame:
    """The alert rows of ``detect_with_values``."""
    return detect_with_values(events, rules, origin, prefixes, lowercased, fold, shown)[0]


def detect_with_values(events: DataFrame, rules, origin=None, prefixes: DataFrame | None = None,
                       lowercased=LOWERCASED, fold: bool = True, shown: A.Shown = A.SHOWN):
    """Run every rule over normalized events: (alert rows, all their entity values as a long table).

    ``events`` needs ``ts`` and a unique ``event_seq``.  ``origin`` anchors the tumbling windows:
    by default the earliest event, or a fixed timestamp (string or Column) for results that do
    not move when older data arrives.  The events are scanned once (twice with the default
    origin, the second reading only ``ts``); the matches are written once and shared by all modes.
    """
    spark = events.sparkSession
    rules = load_rules(rules)
    if not rules:       # no rules, no alerts: the frame of a rule that is never asked
        return tuple(df.filter(F.lit(False)) for df in detect_with_values(events, [{"id": "none", "condition": {"event.action": ""}}]))
    modes = {r.mode for r in rules}
    needed = {"ts", "event_seq", *EVIDENCE}
    for r in rules:
        for part in ("threshold", "sequence", "travel", "beacon"):
            if part == "sequence" and not r.has_sequence:
                continue
            needed |= {f.replace(".", "_") for f in r.key_fields(part)} | set(r.key_fields(part))
        for f in (r.threshold.get("distinct_field"), r.window.get("geo_field"),
                  "source.ip" if r.mode == "travel" else None):
            if f:
                needed |= {f, f.replace(".", "_")}
    hits = rule_hits(events, rules, lowercased, keep=[c for c in events.columns if c in needed
                                                      and c != "ts"])
    hits = with_evidence(hits)
    if modes != {"single"}:     # every other mode reads the matches more than once
        hits = materialize(hits, "hits")

    parts = []
    if "threshold" in modes:
        start = origin_of(events) if origin is None else micros(
            F.lit(origin) if not isinstance(origin, Column) else origin)
        parts.append(threshold_members(hits, rules, start))
    if any(r.has_sequence for r in rules):
        seq = sequence_alert_members(hits, rules)
        both = [i for i, r in enumerate(rules) if r.mode == "threshold" and r.has_sequence]
        if both:    # such a rule reports its sequence only when its threshold stayed quiet
            fired = parts[0].filter(F.col("rule_ix").isin(both)).select("rule_ix").distinct()
            seq = seq.join(fired, "rule_ix", "left_anti")
        parts.append(seq)
    if "travel" in modes:
        parts.append(travel_members(hits, rules, prefixes if prefixes is not None
                                    else geo_prefixes(spark)))
    if "beacon" in modes:
        parts.append(beacon_members(hits, rules))

    found = values = None
    if parts:
        members = parts[0]
        for p in parts[1:]:
            members = members.unionByName(p)
        # entities, distinct values, samples and counts each read the members
        members = materialize(members, "members")
        found = A.summarize(members, shown).withColumn("repeat_count", F.lit(1))
        if fold:
            found = A.fold_repeats(found)
        values = A.entity_values(members)
    if "single" in modes:
        single = A.single_event_alerts(hits, rules)
        own = A.listed_values(single)
        found = single if found is None else found.unionByName(single)
        values = own if values is None else values.unionByName(own)
    return A.finish(found, rules), values


def run_summary(events: DataFrame, alerts: DataFrame, rules) -> DataFrame:
    """One row: alerts, distinct rules fired, events scanned, rules in the pack."""
    spark = events.sparkSession
    total = rules_frame(spark, rules).agg(F.count(F.lit(1))).scalar()
    scanned = events.agg(F.count(F.lit(1))).scalar()
    return alerts.agg(F.count(F.lit(1)).alias("alerts"),
                      F.count_distinct("rule_id").alias("rules_fired")).select(
        "alerts", "rules_fired", scanned.alias("events_scanned"), total.alias("rules_total"))
