"""Incidents kept up to date batch by batch, with identities that outlive merges and late alerts.

A batch of alerts changes some deduplicated alerts, those touch the time slices of their entity
values, and only there are links between neighbours found anew.  Components are recomputed for the
incidents that such links join or part; all others stay as they are.  The outcome is that of one run
over all alerts (``incidents(dedup_alerts(alerts), order="time")``), except for the case numbers.

A rebuilt incident keeps the case id of the earlier incident it shares most alerts with, if that one
has most of its alerts in it too; otherwise it gets a new id.  Ids that end this way are kept in a
table with the case that took most of their alerts, so decisions about them are not lost.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from secframe.functions.values import micros
from secframe.operators.components import connected_components
from secframe.operators.correlate import (HOUR, build_incidents, close_pairs, correlation_keys, dedup_parts, entity_rows, merge_parts,
                                          render_parts)
from secframe.operators.skew import global_rank, time_slices
from secframe.functions.values import floor_div
from secframe.session import materialize
from secframe.streaming.versions import Versions

PLACE = ["kind", "value", "slice"]


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


class CaseTables:
    """Stored state: folded alerts, links, members with their case, ended cases, incidents."""

    def __init__(self, spark: SparkSession, base: str, incidents_path: str, parts: str):
        table = lambda name, keys, schema: Versions(spark, f"{base}/{name}", keys, schema)
        self.alerts = table("alerts", ["akey"], parts)
        self.links = table("links", PLACE, "kind string, value string, slice bigint, a string, b string")
        self.members = table("members", ["akey"], "akey string, label string, case_id string")
        self.ended = ended_cases(spark, base)
        self.incidents_path = incidents_path


def ended_cases(spark: SparkSession, base: str) -> Versions:
    """(old_case, case_id): where the alerts of cases that ended went."""
    return Versions(spark, f"{base}/ended", ["old_case"], "old_case string, case_id string")


def _sliced(alerts: DataFrame, span: int) -> DataFrame:
    """Entity rows of folded alerts in every time slice that looks at them."""
    rows = entity_rows(correlation_keys(alerts, "akey"), "akey")
    return time_slices(rows.withColumn("t", micros(F.col("last_seen"))), "t", back=span)


def _links(rows: DataFrame, span: int) -> DataFrame:
    me = F.struct("alert_id", "akey", "last_seen", "sets")
    w = Window.partitionBy(*PLACE).orderBy("t", "alert_id")
    near = close_pairs(rows.withColumn("prev", F.lag(me).over(w)).filter("own"), span)
    return near.select(*PLACE, F.col("akey").alias("a"), F.col("prev.akey").alias("b"))


def _cases(comp: DataFrame, known: DataFrame, batch_id: int):
    """((label, case_id), (old_case, case_id) of ended cases) by largest mutual overlap."""
    votes = comp.join(known.select("akey", F.col("case_id").alias("old_case")), "akey").groupBy("label", "old_case").agg(F.count(F.lit(1)).alias("n"))
    votes = materialize(votes, "votes")
    first = lambda by, other: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), other))
    ranked = votes.withColumn("mine", first("label", "old_case")).withColumn("its", first("old_case", "label"))
    kept = ranked.filter("mine = 1 AND its = 1").select("label", F.col("old_case").alias("kept"))
    fresh = F.concat(F.lit("INC-"), F.upper(F.substring(F.sha1(F.concat_ws("|", "label", F.lit(str(batch_id)))), 1, 12)))
    cases = materialize(comp.select("label").distinct().join(kept, "label", "left").select("label", F.coalesce("kept", fresh).alias("case_id")), "cases")
    over = ranked.filter("its = 1").join(cases, "label").filter("old_case <> case_id").select("old_case", "case_id")
    return cases, over


def refresh_incidents(alerts_path: str, incidents_path: str, window_minutes: float = 90, dedup: bool = True):
    """foreachBatch handler: fold the batch's alerts into the stored state and update the incidents.

    State lives under ``alerts_path``, incidents under ``incidents_path``.  Work per batch follows the
    alerts, entity values and incidents that the batch touches; the stored tables are only scanned.
    With ``dedup=False`` every alert id is an alert of its own.
    """
    span = int(window_minutes * 60_000_000)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = dedup_parts(batch, by_id=not dedup)
        state = CaseTables(spark, alerts_path, incidents_path, _ddl(new))
        before = state.alerts.current(batch_id)
        replaced = materialize(before.join(new.select("akey"), "akey", "left_semi"), "replaced")
        changed = state.alerts.write(merge_parts(replaced.unionByName(new)), batch_id)
        if changed.isEmpty():
            for t in (state.links, state.members, state.ended):
                t.write(t.current(batch_id).limit(0), batch_id)
            return
        alerts = before.join(changed.select("akey"), "akey", "left_anti").unionByName(changed)

        # links are found anew in the slices that old and new versions of changed alerts lie in
        both = _sliced(render_parts(replaced), span).select(*PLACE).unionByName(_sliced(render_parts(changed), span).select(*PLACE))
        touched = materialize(both.distinct(), "touched")
        links_before = state.links.current(batch_id)
        was = links_before.join(touched, PLACE, "left_semi")
        found = materialize(_links(_sliced(render_parts(alerts), span).join(touched, PLACE, "left_semi"), span), "links")
        state.links.write(touched.join(found, PLACE, "left"), batch_id)
        links = links_before.join(touched, PLACE, "left_anti").unionByName(found).filter("a IS NOT NULL")

        # components of all incidents that have a changed alert or link
        ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("akey")).filter("akey IS NOT NULL")
        known = state.members.current(batch_id)
        seen = changed.select("akey").unionByName(ends(was)).unionByName(ends(found)).distinct()
        labels = known.join(seen, "akey", "left_semi").select("label").distinct()
        old_members = materialize(known.join(labels, "label", "left_semi"), "old-members")
        nodes = materialize(seen.unionByName(old_members.select("akey")).distinct(), "nodes")
        inside = links.join(nodes.withColumnRenamed("akey", "a"), "a", "left_semi").select("a", "b")
        comp = connected_components(inside, nodes.select(F.col("akey").alias("node"))).select(F.col("node").alias("akey"), F.col("component").alias("label"))
        comp = materialize(comp, "relabelled")
        cases, over = _cases(comp, old_members, batch_id)
        state.members.write(comp.join(cases, "label").select("akey", "label", "case_id"), batch_id)
        over = materialize(over, "over")
        moved = state.ended.current(batch_id).withColumnRenamed("case_id", "mid").join(
            over.select(F.col("old_case").alias("mid"), "case_id"), "mid").select("old_case", "case_id")
        state.ended.write(over.unionByName(moved), batch_id)

        # the incidents themselves
        live = materialize(render_parts(alerts.join(nodes, "akey", "left_semi")).join(comp, "akey"), "live-alerts")
        named = live.groupBy("label").agg(F.min("alert_id").alias("component"))
        of = live.select("alert_id", "label").join(named, "label").select("alert_id", "component")
        built = build_incidents(live.drop("akey", "label"), of).drop("case_id", "rank")
        built = built.join(named.join(cases, "label").select("component", "case_id"), "component")
        Versions(spark, incidents_path, ["case_id"], _ddl(built)).write(built, batch_id, over.select(F.col("old_case").alias("case_id")))
    return refresh


def latest_incidents(spark: SparkSession, incidents_path: str) -> DataFrame:
    """All incidents as of the last batch, ranked by score."""
    stored = spark.read.option("mergeSchema", "true").parquet(f"{incidents_path.rstrip('/')}/*").drop("live")
    now = Versions(spark, incidents_path, ["case_id"], _ddl(stored)).current()
    out = global_rank(now.withColumn("_hour", floor_div(micros(F.col("opened_at")), HOUR)), [("score", True), ("_hour", False)],
                      [F.col("opened_at"), F.col("component")], "rank")
    return out.drop("_hour")


def follow_cases(decisions: DataFrame, ended: DataFrame) -> DataFrame:
    """Decisions about cases that ended, moved to the case that took most of their alerts."""
    return (decisions.withColumnRenamed("case_id", "old_case").join(ended, "old_case", "left")
            .withColumn("case_id", F.coalesce("case_id", "old_case")).drop("old_case"))
