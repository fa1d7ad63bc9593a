"""Incidents -> recommended response plan (a table; nothing is executed)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from secframe.functions.net import ipv4_number, is_internal
from secframe.operators.correlate import merged_entities
from secframe.plans import settings as cfg
from secframe.session import materialize

SCOPED_VALUES = 6
NO_RESPONSE = "no alert met the policy bar"


def triggers(members: DataFrame) -> DataFrame:
    """Alerts strong enough to act on."""
    strong = F.col("confidence").isin("high", "medium")
    return members.filter((F.col("severity") == "critical")
                          | ((F.col("severity") == "high") & strong) | (F.col("score") >= 80))


def selected_actions(trig: DataFrame, playbooks: DataFrame) -> DataFrame:
    """(case_id, action, step): actions of every playbook that shares a tactic with a trigger."""
    tactics = trig.select("case_id", "tactic").distinct()
    return (tactics.join(playbooks, "tactic").groupBy("case_id", "action")
            .agg(F.min("step").alias("step")))


def blockable(ip: Column) -> Column:
    """Only a valid external IPv4 address may be blocked."""
    return F.when(ipv4_number(ip).isNotNull() & ~is_internal(ip), F.trim(ip))


def _target(action: Column, case_id: Column) -> Column:
    ent = lambda k: F.get(F.coalesce(F.col("scoped").getItem(k), F.col("fallback").getItem(k)),
                          F.lit(0))
    na = F.lit("n/a")
    return (F.when(action == "block_ip_at_waf",
                   F.coalesce(blockable(ent("source_ip")), blockable(ent("destination_ip")),
                              F.lit("-")))
            .when(action.isin("disable_account", "force_password_reset", "revoke_sessions",
                              "require_mfa_reenrollment"), F.coalesce(ent("user_name"), na))
            .when(action == "isolate_host", F.coalesce(ent("host_name"), na))
            .when(action == "kill_process_tree", F.coalesce(ent("process_name"), na))
            .when(action == "quarantine_file",
                  F.coalesce(ent("file_path"), ent("process_command_line"), na))
            .when(action == "create_ticket", case_id))


def _result(action: Column, target: Column) -> Column:
    skip_ip = (action == "block_ip_at_waf") & (target == "-")
    builtin = (action == "disable_account") & F.lower(target).isin(cfg.BUILTIN_ACCOUNTS)
    return (F.when(skip_ip, "SKIPPED - no external address in evidence")
            .when(builtin, "SKIPPED - built-in identity, reset credentials instead")
            .otherwise("recommended"))


def response_plan(incidents: DataFrame, alerts: DataFrame, membership: DataFrame,
                  playbooks: DataFrame | None = None, run_ts=None, values: DataFrame | None = None) -> DataFrame:
    """One row per (incident, action, target); incidents below the bar get one ``none`` row.

    The target is the first value in the evidence of the triggering alerts; ``values`` is the long
    table of all entity values, without which the alerts' lists count.
    """
    playbooks = cfg.playbooks(alerts.sparkSession) if playbooks is None else playbooks
    members = (alerts.join(membership, "alert_id")
               .join(incidents.select("component", "case_id"), "component"))
    trig = triggers(members).select("case_id", "alert_id", "first_seen", "tactic", "rule_id", "entities")
    trig = materialize(trig, "triggers")     # read by five branches
    scoped = merged_entities(trig, "case_id", SCOPED_VALUES, values).withColumnRenamed("entities", "scoped")
    why = trig.groupBy("case_id").agg(F.concat(
        F.array_join(F.array_sort(F.collect_set("tactic")), " + "), F.lit(" -> "),
        F.array_join(F.array_sort(F.collect_set("rule_id")), ", ")).alias("justification"))
    own = incidents.select("case_id", F.col("entities").alias("fallback"))
    plan = (selected_actions(trig, playbooks).join(why, "case_id").join(scoped, "case_id", "left")
            .join(own, "case_id", "left"))
    plan = plan.withColumn("target", _target(F.col("action"), F.col("case_id")))
    plan = plan.withColumn("result", _result(F.col("action"), F.col("target")))
    first = Window.partitionBy("case_id", "action", "target").orderBy("step")
    plan = plan.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    at = F.lit(run_ts).cast("timestamp")
    ticket = F.concat(F.lit("AUTO-"), F.substring(F.sha1(F.concat_ws("|", "action", "case_id")), 1, 8))
    plan = plan.select("case_id", "step", "action", "target", "result", "justification",
                       ticket.alias("ticket"), at.alias("executed_at"))
    quiet = (incidents.select("case_id").join(trig.select("case_id").distinct(), "case_id", "left_anti")
             .select("case_id", F.lit(-1).alias("step"), F.lit("none").alias("action"),
                     F.lit("-").alias("target"), F.lit("no automated response").alias("result"),
                     F.lit(NO_RESPONSE).alias("justification"),
                     F.lit(None).cast("string").alias("ticket"),
                     F.lit(None).cast("timestamp").alias("executed_at")))
    return plan.unionByName(quiet)


def contain(incidents: DataFrame, plan: DataFrame,
            lag_minutes: float = cfg.RESPONSE_LAG_MINUTES) -> DataFrame:
    """Incidents with a response become contained, a fixed lag after their last activity."""
    acted = plan.filter(F.col("action") != "none").select("case_id").distinct().withColumn(
        "_acted", F.lit(True))
    done = F.coalesce("_acted", F.lit(False)) & (F.col("status") == "new")
    lag = F.make_dt_interval(mins=F.lit(int(lag_minutes)))
    return (incidents.join(acted, "case_id", "left")
            .withColumn("contained_at", F.when(done, F.col("last_activity") + lag))
            .withColumn("status", F.when(done, "contained").otherwise(F.col("status")))
            .drop("_acted"))
