import json

import pytest
from pyspark.sql import functions as F

from secframe.operators.correlate import correlate, dedup_alerts, incidents
from secframe.operators.enrich import enrich
from secframe.operators.respond import contain, response_plan
from secframe.operators import views as V

SCHEMA = ("alert_id string, rule_id string, rule_name string, severity string, confidence string, risk int, "
          "tactic string, technique array<string>, count bigint, first_seen timestamp, last_seen timestamp, "
          "entities map<string,array<string>>, note string, repeat_count int, prior_events bigint, "
          "max_bytes double, baseline struct<cov:double>, score int")


def alert(aid, rule, sev, tactic, first, last, entities, score=84, conf="high", risk=70):
    import datetime as dt
    at = lambda s: dt.datetime.fromisoformat(f"2026-09-02T{s}+00:00")
    return (aid, rule, rule.lower(), sev, conf, risk, tactic, ["T" + rule], 3, at(first), at(last),
            {k: [v] for k, v in entities.items()}, "", 1, None, 0.0, None, score)


GUESS = alert("g1", "GUESS", "high", "credential-access", "11:05:00", "11:20:30",
              {"source_ip": "192.0.2.200", "user_name": "t.okafor", "host_name": "LAB-PC-3"}, 71)
SHELL = alert("s1", "SHELL", "medium", "execution", "11:41:00", "11:41:10",
              {"user_name": "t.okafor", "host_name": "LAB-PC-3", "process_name": "wscript.exe"}, 48)
SWEEP = alert("p1", "SWEEP", "low", "discovery", "11:30:00", "11:34:00",
              {"source_ip": "198.18.4.4", "destination_ip": "10.77.0.8"}, 33)


@pytest.fixture
def alerts(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SCHEMA)


def groups(components):
    out = {}
    for r in components.collect():
        out.setdefault(r.component, set()).add(r.alert_id)
    return sorted(map(sorted, out.values()))


def test_dedup_adds_up_repeats(alerts):
    later = alert("g2", "GUESS", "high", "credential-access", "11:50:00", "11:52:00",
                  {"source_ip": "192.0.2.200", "user_name": "t.okafor", "host_name": "LAB-PC-3"}, 71)
    rows = {r.rule_id: r for r in dedup_alerts(alerts(GUESS, later, SWEEP)).collect()}
    assert set(rows) == {"GUESS", "SWEEP"} and rows["GUESS"].deduped_from == 2 and rows["GUESS"]["count"] == 6
    assert rows["SWEEP"]["count"] == 3


@pytest.mark.parametrize("order", ["score", "time"])
def test_shared_user_and_host_correlate_within_the_window(alerts, order):
    assert groups(correlate(alerts(GUESS, SHELL, SWEEP), order=order)) == [["g1", "s1"], ["p1"]]
    night = alert("n1", "SHELL", "medium", "execution", "20:00:00", "20:00:10",
                  {"user_name": "t.okafor", "host_name": "LAB-PC-3"}, 48)
    assert groups(correlate(alerts(GUESS, night), order=order)) == [["g1"], ["n1"]]


def test_one_weak_key_is_not_enough(alerts):
    def pair(**shared):
        return alerts(*[alert(i, r, "low", "exfiltration", t, t, shared)
                        for i, r, t in (("u", "R1", "12:00:00"), ("v", "R2", "12:09:00"))])
    assert groups(correlate(pair(source_ip="198.18.9.1"))) == [["u"], ["v"]]
    assert groups(correlate(pair(source_ip="198.18.9.1", destination_domain="sink.test"))) == [["u", "v"]]
    assert groups(correlate(pair(source_ip="172.16.3.3", process_name="tool"))) == [["u"], ["v"]]  # internal


def test_incidents_plan_and_metrics(alerts, spark):
    a = alerts(GUESS, SHELL, SWEEP)
    inc, members = incidents(a, run_ts="2026-09-02 18:00:00")
    first, second = sorted(inc.collect(), key=lambda r: r.rank)
    assert (first.case_id, second.case_id) == ("INC-20260902-001", "INC-20260902-002")
    assert first.severity == "high" and first.alert_count == 2 and second.alert_count == 1
    assert first.chain == "execution -> credential-access"
    plan = response_plan(inc, a, members)
    acts = {(r.case_id, r.action): r for r in plan.collect()}
    assert acts[(first.case_id, "block_ip_at_waf")].target == "192.0.2.200"
    done = {r.case_id: r.status for r in contain(inc, plan).collect()}
    assert done[first.case_id] == "contained"
    known = spark.createDataFrame([("GUESS",), ("SHELL",), ("SWEEP",), ("IDLE",)], "rule_id string")
    m = V.ops_metrics(6000, contain(inc, plan), plan, a, known, 3.0).first()
    assert (m.incidents, m.detection_gap_pct, m.throughput_eps) == (2, 25.0, 2000)
    exported = V.evidence_export(a, contain(inc, plan), members)
    assert {r.case_id for r in exported.collect()} == {first.case_id, second.case_id}


def test_guards_skip_internal_addresses_and_system_accounts(alerts):
    a = alerts(alert("k", "DUMP", "critical", "credential-access", "13:00:00", "13:00:05",
                     {"user_name": "SYSTEM", "source_ip": "10.9.8.7", "host_name": "LAB-PC-9"}, 97))
    inc, members = incidents(a)
    results = {r.action: r.result for r in response_plan(inc, a, members).collect()}
    assert {k for k, v in results.items() if v.startswith("SKIPPED")} >= {"block_ip_at_waf", "disable_account"}


def test_enrichment_by_domain_label(alerts):
    known = alert("d1", "CALL", "critical", "command-and-control", "14:00:00", "14:00:00",
                  {"source_ip": "10.10.31.44", "destination_domain": "edge.CDN-update-service.net",
                   "user_name": "t.okafor"}, risk=90)
    e = enrich(alerts(known).drop("score")).first()
    assert [i.category for i in e.intel] == ["c2"] and e.triage_suggested == "escalate"
    other = alert("d2", "CALL", "low", "impact", "14:00:00", "14:00:00",
                  {"destination_domain": "mycdn-update-service.net"})
    assert enrich(alerts(other).drop("score")).first().intel == []


def counted(df):
    """The frame, and an accumulator of how many rows were computed for all its readers."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(pass_on, df.schema), seen


def test_enrichment_computes_its_alerts_once(alerts):
    rows, seen = counted(alerts(GUESS, SHELL, SWEEP).drop("score"))
    assert enrich(rows).count() == 3 and enrich(rows).select("score").distinct().count() >= 1
    assert seen.value == 6      # once per call


def test_response_plan_computes_its_alerts_once(alerts):
    a = alerts(GUESS, SHELL, SWEEP)
    inc, members = incidents(a)
    rows, seen = counted(a)
    assert len(response_plan(inc, rows, members).collect()) > 2
    assert seen.value == 3


def test_feed_hits_of_repeated_and_untrimmed_values(alerts, spark):
    from secframe.operators.enrich import match_domains, match_ips
    from secframe.plans import settings as cfg
    row = lambda aid, kind, v: (aid, kind, (0, 0, 0), v)
    values = spark.createDataFrame([
        row("a", "source_ip", " 203.0.113.44"), row("b", "source_ip", "203.0.113.44"), row("b", "destination_ip", "45.155.205.7"),
        row("a", "destination_domain", "x.exfil-drop.cloud"), row("b", "destination_domain", "x.exfil-drop.cloud"),
        row("c", "destination_domain", "notexfil-drop.cloud"), row("c", "source_ip", None)],
        "alert_id string, kind string, pos struct<place:int,t:bigint,event_seq:bigint>, value string")
    ips = match_ips(values, cfg.intel_ip(spark), cfg.geo_prefixes(spark)).collect()
    assert sorted((r.alert_id, r.value, r.confidence, r.feed) for r in ips) == [
        ("a", "203.0.113.44", 88, "abuseipdb"), ("b", "203.0.113.44", 88, "abuseipdb"), ("b", "45.155.205.7", 60, "static-anonymizer-list")]
    domains = match_domains(values, cfg.intel_domain(spark)).collect()
    assert sorted((r.alert_id, r.category) for r in domains) == [("a", "exfil-host"), ("b", "exfil-host")]


def test_journal_order_over_files(spark, tmp_path):
    line = lambda status, at: json.dumps({"case_id": "C7", "status": status, "decided_at": at}) + "\n"
    (tmp_path / "a.jsonl").write_text(line("closed", "2026-03-02T10:00:00") * 1 + "x" * 4000 + "\n")
    (tmp_path / "b.jsonl").write_text(line("open", "2026-03-01T09:00:00"))
    (row,) = V.latest_decisions(V.read_journal(spark, str(tmp_path))).collect()
    assert row.status == "closed"


def test_journal(spark, tmp_path):
    line = lambda c, s, n: json.dumps({"case_id": c, "status": s, "note": n})
    path = tmp_path / "journal.jsonl"
    path.write_text("\n".join([line("I1", "false-positive", "first"), "not json", line("I1", "contained", "second"),
                               line("I2", "false-positive", "scanner"), json.dumps({"status": "x"})]) + "\n")
    latest = {r.case_id: r for r in V.latest_decisions(V.read_journal(spark, str(path))).collect()}
    assert set(latest) == {"I1", "I2"} and latest["I1"].note == "second"


def test_streaming_refresh_handler(alerts, spark, tmp_path):
    from secframe.streaming.cases import latest_incidents, refresh_incidents
    a, i = str(tmp_path / "alerts"), str(tmp_path / "incidents")
    refresh = refresh_incidents(a, i)
    refresh(alerts(GUESS, SWEEP), 0)
    assert latest_incidents(spark, i).count() == 2
    refresh(alerts(SHELL), 1)
    refresh(alerts(SHELL), 1)         # a repeated batch replaces itself
    got = latest_incidents(spark, i)
    assert got.count() == 2 and got.agg(F.max("alert_count")).first()[0] == 2


def many(spark, place):
    """An alert with 40 addresses, the listed one at ``place``, and one that shares its last user."""
    ips = [f"198.18.0.{i}" for i in range(40)]
    ips[place] = "192.0.2.99"
    rows = [("m1", "source_ip", i, v) for i, v in enumerate(ips)] + [("m1", "user_name", i, f"u{i}") for i in range(30)]
    rows += [("m2", "user_name", 0, "u29"), ("m3", "source_ip", 0, ips[39]), ("m3", "process_name", 0, "x.exe"), ("m1", "process_name", 0, "x.exe")]
    values = spark.createDataFrame(rows, "alert_id string, kind string, i int, value string").selectExpr(
        "alert_id", "kind", "named_struct('place', 0, 't', CAST(i AS BIGINT), 'event_seq', 0L) AS pos", "value")
    return values


@pytest.mark.parametrize("place", [0, 39])
def test_values_beyond_the_shown_lists_count(alerts, spark, place):
    values = many(spark, place)
    a = alerts(alert("m1", "WIDE", "high", "discovery", "10:00:00", "10:05:00", {"source_ip": "198.18.0.0", "user_name": "u0"}),
               alert("m2", "USER", "low", "discovery", "10:06:00", "10:06:00", {"user_name": "u29"}),
               alert("m3", "PAIR", "low", "discovery", "10:07:00", "10:07:00", {"process_name": "x.exe"}))
    e = {r.alert_id: r for r in enrich(a.drop("score"), values=values).collect()}
    assert e["m1"].intel_hits == 1 and e["m1"].intel[0].feed == "feodo-block-list" and e["m2"].intel_hits == 0
    assert e["m1"].score == enrich_score(alerts, spark, values)
    for order in ("score", "time"):
        assert groups(correlate(a, order=order, values=values)) == [["m1", "m2", "m3"]]
    inc, members = incidents(a, values=values)
    (row,) = inc.collect()
    assert row.entity_count == 40 + 30 + 1 and len(row.entities["source_ip"]) == 12


def enrich_score(alerts, spark, values):
    """The score does not depend on where the listed address stands."""
    a = alerts(alert("m1", "WIDE", "high", "discovery", "10:00:00", "10:05:00", {"source_ip": "198.18.0.0", "user_name": "u0"}))
    return enrich(a.drop("score"), values=many(spark, 7)).filter("alert_id = 'm1'").first().score
