"""Alert rows: counts, times, entities, distinct values and evidence samples.

Groups behind an alert can be huge, so nothing here collects raw events.  The lists an alert row
shows (``Shown``: 12 values per entity, 25 distinct values, 6 samples by default) are chosen by rank
first.  All entity values are in the long table ``entity_values`` (alert_id, kind, pos, value), which
enrichment, correlation and the response plan read instead of the lists.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from secframe.operators.hits import DISTINCT_FIELDS, ENTITY_FIELDS, literal_by_rule
from secframe.operators.skew import first_k


@dataclass(frozen=True)
class Shown:
    """How much an alert row shows; joins and scores see everything."""
    entity_values: int = 12
    distinct_values: int = 25
    sample_rows: int = 6
    sample_chars: int = 160


SHOWN = Shown()

ENTITIES_TYPE = "map<string,array<string>>"
SAMPLE_TYPE = "array<struct<ts:timestamp,action:string,text:string>>"
GEO_TYPE = "struct<from:string,to:string,distance_km:bigint,minutes:double,required_speed_kmh:bigint>"
BASELINE_TYPE = ("struct<interval_mean_s:double,interval_stdev_s:double,cov:double,"
                 "events_in_window:bigint>")

# facts a mode may add to its alerts
HEAD = [("note", "string"), ("distinct_count", "bigint"), ("prior_events", "bigint"),
        ("geo", GEO_TYPE), ("baseline", BASELINE_TYPE)]


def alert_id(*parts) -> Column:
    return F.sha1(F.concat_ws("\u0001", *[p.cast("string") for p in parts]))


def rule_name_of(rules) -> Column:
    """The rule's own id, so that alert ids do not move with its place in the list."""
    return literal_by_rule([r.id for r in rules], "string")


def head_columns(**given) -> list:
    return [(given[n] if n in given else F.lit(None)).cast(t).alias(n) for n, t in HEAD]


def _text(name: str) -> Column:
    value = F.col(name).cast("string")
    return F.when(value != "", value)


def sample_text(chars: int = SHOWN.sample_chars) -> Column:
    return F.substring(F.coalesce(_text("process_command_line"), _text("url_path"),
                                  _text("dns_question_name"), _text("file_path"), F.lit("")),
                       1, chars)


def transfer_bytes() -> Column:
    size = lambda n: F.coalesce(F.col(n).cast("string").try_cast("double"), F.lit(0.0))
    return F.greatest(size("network_bytes"), size("bytes_sent"))


def _values(members: DataFrame, fields) -> DataFrame:
    """Distinct (alert, field, value) with the first place each value occurs."""
    pairs = F.array_compact(F.array(*[
        F.when(_text(f).isNotNull(), F.struct(F.lit(f).alias("field"), _text(f).alias("value")))
        for f in fields]))
    return (members.select("alert_id", "place", "t", "event_seq", F.explode(pairs).alias("p"))
            .groupBy("alert_id", F.col("p.field").alias("field"), F.col("p.value").alias("value"))
            .agg(F.min(F.struct("place", "t", "event_seq")).alias("at")))


def _ranked_values(df: DataFrame) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))),
                       lambda x: x["value"])


PLACE = "struct<place:int,t:bigint,event_seq:bigint>"


def entity_values(members: DataFrame) -> DataFrame:
    """All distinct entity values of alerts: (alert_id, kind, pos, value), ``pos`` being the first place of each."""
    return _values(members, ENTITY_FIELDS).select("alert_id", F.col("field").alias("kind"), F.col("at").cast(PLACE).alias("pos"), "value")


def listed_values(alerts: DataFrame, *keep: str) -> DataFrame:
    """The same from the lists of alert rows, for alerts that carry all their values in them."""
    return (alerts.select("alert_id", *keep, F.explode("entities").alias("kind", "values"))
            .select("alert_id", *keep, "kind", F.posexplode("values").alias("i", "value"))
            .select("alert_id", *keep, "kind", F.struct(F.lit(0).alias("place"), F.col("i").cast("bigint").alias("t"),
                                                 F.lit(0).cast("bigint").alias("event_seq")).cast(PLACE).alias("pos"), "value"))


def entity_lists(members: DataFrame, keep: int = SHOWN.entity_values) -> DataFrame:
    """The first distinct values per (alert, field), in event order."""
    kept = first_k(_values(members, ENTITY_FIELDS), ["alert_id", "field"], ["at", "value"], keep)
    return kept.groupBy("alert_id", "field").agg(_ranked_values(kept).alias("values"))


def distinct_lists(members: DataFrame, keep: int = SHOWN.distinct_values) -> DataFrame:
    """The first distinct values per (alert, field) in value order, only where there are several."""
    kept = first_k(_values(members, DISTINCT_FIELDS), ["alert_id", "field"], ["value"], max(2, keep))
    return (kept.groupBy("alert_id", "field").agg(_ranked_values(kept).alias("values"))
            .filter(F.size("values") > 1))


def samples(members: DataFrame, shown: Shown = SHOWN) -> DataFrame:
    """First events of each alert: time, action and the most telling text."""
    kept = first_k(members.select("alert_id", "place", "t", "event_seq", "event_action",
                                  sample_text(shown.sample_chars).alias("text")),
                   ["alert_id"], ["place", "t", "event_seq"], shown.sample_rows)
    row = F.struct("rank", F.timestamp_micros("t").alias("ts"),
                   F.col("event_action").alias("action"), "text")
    return kept.groupBy("alert_id").agg(
        F.transform(F.array_sort(F.collect_list(row)),
                    lambda x: F.struct(x["ts"].alias("ts"), x["action"].alias("action"),
                                       x["text"].alias("text"))).alias("sample"))


def summarize(members: DataFrame, shown: Shown = SHOWN) -> DataFrame:
    """Members (one row per alert and event) -> one row per alert.

    The pieces are small by construction, so they meet in a single final grouping.
    """
    blank = lambda t: F.lit(None).cast(t)
    stats = (members.groupBy("alert_id", "rule_ix")
             .agg(F.count(F.lit(1)).alias("count"), F.min("t").alias("first_t"),
                  F.max("t").alias("last_t"), F.max(transfer_bytes()).alias("max_bytes"),
                  *[F.first(n, ignorenulls=True).alias(n) for n, _ in HEAD])
             .select("alert_id", F.struct("rule_ix", "count", "first_t", "last_t", "max_bytes",
                                          *[n for n, _ in HEAD]).alias("stats")))
    listed = "struct<field:string,values:array<string>>"
    pieces = [
        stats.select("alert_id", "stats", blank(listed).alias("e"), blank(listed).alias("d"),
                     blank(SAMPLE_TYPE).alias("sample")),
        entity_lists(members, shown.entity_values).select("alert_id", F.struct("field", "values").alias("e")),
        distinct_lists(members, shown.distinct_values).select("alert_id", F.struct("field", "values").alias("d")),
        samples(members, shown).select("alert_id", "sample")]
    whole = pieces[0]
    for p in pieces[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return (whole.groupBy("alert_id").agg(
        F.first("stats", ignorenulls=True).alias("stats"),
        F.map_from_entries(F.collect_list("e")).alias("entities"),
        F.map_from_entries(F.collect_list("d")).alias("distinct"),
        F.first("sample", ignorenulls=True).alias("sample"))
        .select("alert_id", "stats.*", "entities", "distinct", "sample"))


def single_event_alerts(hits: DataFrame, rules) -> DataFrame:
    """Single-event rules: every hit is an alert, already folded per (rule, source, host, user).

    A hit has one value per field, so its alert needs no grouping; folding equal ones first keeps
    a rule that matches a third of all events from producing that many wide rows.
    """
    mine = [i for i, r in enumerate(rules) if r.mode == "single"]
    rows = hits.filter(~F.col("is_prior") & F.col("rule_ix").isin(mine))
    event = F.struct("t", "event_seq", "event_action", sample_text().alias("text"),
                     *[F.col(f).cast("string").alias(f) for f in ENTITY_FIELDS])
    folded = (rows.groupBy("rule_ix", _text("source_ip").alias("_src"),
                           _text("host_name").alias("_host"), _text("user_name").alias("_user"))
              .agg(F.count(F.lit(1)).alias("count"), F.max("t").alias("last_t"),
                   F.max(transfer_bytes()).alias("max_bytes"),
                   F.min_by(event, F.struct("t", "event_seq")).alias("ev")))
    text = lambda f: F.when(F.col(f"ev.{f}") != "", F.col(f"ev.{f}"))
    entities = F.map_from_entries(F.array_compact(F.array(*[
        F.when(text(f).isNotNull(), F.struct(F.lit(f).alias("field"),
                                             F.array(text(f)).alias("values")))
        for f in ENTITY_FIELDS])))
    sample = F.array(F.struct(F.timestamp_micros("ev.t").alias("ts"),
                              F.col("ev.event_action").alias("action"),
                              F.col("ev.text").alias("text")))
    return folded.select(
        alert_id(rule_name_of(rules), F.lit("single"), F.col("ev.t"), F.col("ev.event_seq"))
        .alias("alert_id"), "rule_ix", "count", F.col("ev.t").alias("first_t"), "last_t",
        "max_bytes", *head_columns(), entities.alias("entities"),
        F.map_from_arrays(F.array().cast("array<string>"),
                          F.array().cast("array<array<string>>")).alias("distinct"),
        sample.cast(SAMPLE_TYPE).alias("sample"), F.col("count").cast("int").alias("repeat_count"))


def fold_repeats(alerts: DataFrame) -> DataFrame:
    """Same rule on the same source, host and user: the first alert stays, counts add up."""
    ent = lambda k: F.col("entities").getItem(k)
    whole = F.struct(*[c for c in alerts.columns])
    out = (alerts.groupBy("rule_ix", ent("source_ip").alias("_src"), ent("host_name").alias("_host"),
                          ent("user_name").alias("_user"))
           .agg(F.min_by(whole, F.struct("first_t", "alert_id")).alias("a"),
                F.sum("count").alias("_count"), F.max("last_t").alias("_last"),
                F.max("max_bytes").alias("_bytes"), F.sum("repeat_count").alias("_repeats")))
    changed = {"count": F.col("_count"), "last_t": F.col("_last"), "max_bytes": F.col("_bytes"),
               "repeat_count": F.col("_repeats").cast("int")}
    return out.select(*[changed.get(c, F.col(f"a.{c}")).alias(c) for c in alerts.columns])


def rule_columns(rules) -> list:
    """Rule metadata picked by rule index: constants in the plan, so no join is needed."""
    pick = lambda name, dtype: literal_by_rule([getattr(r, name) for r in rules], dtype)
    techniques = F.array(*[F.array(*[F.lit(t) for t in r.technique]).cast("array<string>")
                           for r in rules])[F.col("rule_ix")]
    return [pick("id", "string").alias("rule_id"), pick("name", "string").alias("rule_name"),
            pick("severity", "string").alias("severity"),
            pick("confidence", "string").alias("confidence"), pick("risk", "int").alias("risk"),
            pick("tactic", "string").alias("tactic"), techniques.alias("technique")]


def finish(alerts: DataFrame, rules) -> DataFrame:
    """Rule metadata, timestamps and notes."""
    repeats = F.col("repeat_count") - 1
    note = F.concat_ws(" | ", F.when(F.col("note") != "", F.col("note")),
                       F.when(repeats > 0, F.concat(F.lit("repeated hit x"), repeats.cast("string"))))
    return (alerts
            .select("alert_id", *rule_columns(rules), "count", F.timestamp_micros("first_t").alias("first_seen"),
                    F.timestamp_micros("last_t").alias("last_seen"),
                    F.call_function("div", F.col("last_t") - F.col("first_t"),
                                    F.lit(1_000_000)).alias("window_seconds"),
                    "entities", "distinct", "sample", note.alias("note"), "repeat_count",
                    "prior_events", "distinct_count", "geo", "baseline", "max_bytes"))
