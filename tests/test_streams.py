"""Streams with disorder against the batch operators."""
import datetime as dt
import random

import pytest

from secframe.operators.hits import rule_hits
from secframe.operators.sequence import fired_sequences, sequence_rows
from secframe.plans.rules import load_rules
from secframe.session import scratch_path
from secframe.streaming import sequences as Q

START = dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc)
RULES = [{"id": "A", "condition": {"event_action": "login"}, "requires": {
            "condition": {"event_action": "fail"}, "min_count": 2, "window_minutes": 10, "key_fields": ["user_name"]}},
         {"id": "B", "condition": {"event_action": "add"}, "requires": {
             "condition": {"event_action": ["fail", "login"]}, "min_count": 1, "window_minutes": 3, "key_fields": []}}]
SCHEMA = "ts timestamp, event_seq bigint, user_name string, event_action string"


def feed(spark, batches, tag):
    """A stream that gets one file per batch, then an event an hour ahead."""
    path = scratch_path(spark, f"feed-{tag}")
    end = max(r[0] for b in batches for r in b) + dt.timedelta(hours=1)
    for b in [*batches, [(end, -1, None, "tick")]]:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, frame, out):
    q = frame.writeStream.outputMode("append").format("parquet").option("path", out).option(
        "checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def events(n=240, seed=3):
    rnd = random.Random(seed)
    return [(START + dt.timedelta(seconds=rnd.randrange(3600)), i, rnd.choice(["ann", "bob", "hot", "hot", None]), rnd.choice(["fail", "fail", "login", "add", "noise"]))
            for i in range(n)]


@pytest.mark.parametrize("late_s", [0, 240])
def test_sequences_equal_the_batch_result(spark, late_s):
    Q.use_state_store(spark)
    rows = events()
    rnd = random.Random(4)
    arrive = sorted(rows, key=lambda r: (r[0] + dt.timedelta(seconds=rnd.randrange(late_s + 1)), r[1]))
    out = scratch_path(spark, "fired")
    run(spark, Q.stream_sequences(feed(spark, [arrive[i:i + 60] for i in range(0, len(arrive), 60)], late_s), RULES, delay="5 minutes"), out)
    got = sorted(map(tuple, spark.read.schema(Q.FIRED).parquet(out).collect()))
    rules = load_rules(RULES)
    hits = rule_hits(spark.createDataFrame(rows, SCHEMA), rules)
    want = sorted((r.rule_ix, r.key, r.t, r.prior_events) for r in fired_sequences(sequence_rows(hits, rules), rules).collect())
    assert got == want and len(want) > 10


def test_a_hit_that_arrives_before_its_priors_fires(spark):
    Q.use_state_store(spark)
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [[(at(200), 1, "ann", "login")], [(at(100), 2, "ann", "fail"), (at(150), 3, "ann", "fail")], [(at(2000), 4, "bob", "login")]]
    out = scratch_path(spark, "fired")
    run(spark, Q.stream_sequences(feed(spark, batches, "early"), RULES[:1], delay="5 minutes"), out)
    got = [(r.key, r.prior_events) for r in spark.read.schema(Q.FIRED).parquet(out).collect()]
    assert got == [("ann", 2)]


# ---------------------------------------------------------------- incidents
def alert_rows(n, seed):
    from test_incidents import alert
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        at = START.replace(year=2026, month=9, day=2, hour=8) + dt.timedelta(minutes=rnd.randrange(600))
        shared = {"user_name": f"u{rnd.randrange(14)}"} if rnd.random() < 0.5 else {"source_ip": f"198.51.100.{rnd.randrange(5)}", "process_name": f"p{rnd.randrange(4)}"}
        if rnd.random() < 0.3:
            shared["host_name"] = f"H{rnd.randrange(9)}"
        when = at.strftime("%H:%M:%S")
        out.append(alert(f"a{i:03d}", f"R{rnd.randrange(5)}", rnd.choice(["low", "high", "critical"]), "discovery", when, when, shared, rnd.randrange(20, 90)))
    return out


def shown(incidents):
    return sorted((r.component, r.severity, r.score, r.opened_at, r.last_activity, r.alert_count, r.rule_count, r.fingerprint, r.title, tuple(r.triage_notes))
                  for r in incidents.collect())


def test_incidents_over_many_batches_equal_one_run(spark, tmp_path):
    from test_incidents import SCHEMA as ALERTS
    from secframe.operators.correlate import dedup_alerts, incidents
    from secframe.streaming import cases as C
    rows = alert_rows(120, 5)
    random.Random(6).shuffle(rows)                       # late alerts: inserted between others, and before first ones
    state, inc = str(tmp_path / "state"), str(tmp_path / "incidents")
    refresh = C.refresh_incidents(state, inc)
    kept = None
    for i in range(6):
        batch = spark.createDataFrame(rows[i * 20:(i + 1) * 20], ALERTS)
        refresh(batch, i)
        if i == 2:
            refresh(batch, i)                            # a repeated batch replaces itself
            kept = max(C.latest_incidents(spark, inc).collect(), key=lambda r: (r.alert_count, r.case_id))
    got = C.latest_incidents(spark, inc)
    want, _ = incidents(dedup_alerts(spark.createDataFrame(rows, ALERTS)), order="time")
    assert shown(got) == shown(want)
    ids = [r.case_id for r in got.collect()]
    assert len(set(ids)) == len(ids)
    # the case decided upon after the third batch still has its id, or is followed to where its alerts went
    decision = spark.createDataFrame([(kept.case_id, "contained")], "case_id string, status string")
    now = C.follow_cases(decision, C.ended_cases(spark, state).current()).first().case_id
    assert now in ids
    (row,) = [r for r in got.collect() if r.case_id == now]
    assert row.opened_at <= kept.opened_at and row.alert_count >= kept.alert_count - 1


def test_case_ids_over_merge_and_split(spark, tmp_path):
    from test_incidents import SCHEMA as ALERTS, alert
    from secframe.streaming import cases as C
    one = lambda i, at, **who: alert(i, f"R-{i}", "low", "discovery", at, at, who)
    state, inc = str(tmp_path / "s"), str(tmp_path / "i")
    refresh = C.refresh_incidents(state, inc)
    make = lambda *rows: spark.createDataFrame(list(rows), ALERTS)
    refresh(make(one("a", "10:00:00", user_name="ann"), one("b", "10:10:00", user_name="ann"), one("c", "10:20:00", user_name="cid")), 0)
    first = {frozenset(r.rules): r.case_id for r in C.latest_incidents(spark, inc).collect()}
    big, small = first[frozenset({"R-a", "R-b"})], first[frozenset({"R-c"})]
    refresh(make(one("d", "10:15:00", user_name="cid", host_name="H")), 1)
    refresh(make(one("e", "10:16:00", user_name="ann", host_name="H")), 2)
    (all_in_one,) = C.latest_incidents(spark, inc).collect()
    assert all_in_one.alert_count == 5 and all_in_one.case_id in (big, small)
    over = {r.old_case: r.case_id for r in C.ended_cases(spark, state).current().collect()}
    assert over == {({big, small} - {all_in_one.case_id}).pop(): all_in_one.case_id}
