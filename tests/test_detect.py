import datetime as dt
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from secframe.operators.components import connected_components
from secframe.operators.sequence import cooldown
from secframe.operators.skew import exact_median, global_rank, previous_in_order, time_slices
from secframe.plans.detect import detect
from secframe.plans.rulepack import RULES

FAIL = {"event_dataset": "authentication", "event_action": "failed-logon", "source_ip": "192.0.2.61",
        "source_ip_not_private": True, "user_name": "kiosk"}
OK = {**FAIL, "event_action": "successful-logon"}
AT = lambda s: dt.timedelta(hours=9, seconds=s)


def run(events, *ids):
    return detect(events, [r for r in RULES if r["id"] in ids]).collect()


def own_rule(**parts):
    return {"id": "own", "condition": {"event.action": "failed-logon"}, **parts}


def test_threshold_counts_per_window(event_frame):
    rule = own_rule(threshold={"field": "source.ip", "min_events": 4, "window_minutes": 5})
    burst = [(AT(11 * i), FAIL) for i in range(9)]
    (a,) = detect(event_frame(burst), [rule]).collect()
    assert a["count"] == 9 and a.entities["source_ip"] == ["192.0.2.61"] and a.window_seconds == 88
    assert detect(event_frame(burst[:3]), [rule]).collect() == []
    # seven events, but never four inside one window that starts at the first event
    thin = [(AT(130 * i), FAIL) for i in range(7)]
    assert detect(event_frame(thin), [rule]).collect() == []


def test_shipped_threshold(event_frame):
    (a,) = run(event_frame([(AT(5 * i), FAIL) for i in range(55)]), "SOC-BRUTE-001")
    assert a["count"] == 55 and a.severity == "high"


def test_distinct_threshold(event_frame):
    rule = own_rule(threshold={"field": "source.ip", "distinct_field": "user.name", "min_events": 3,
                               "min_distinct": 3, "window_minutes": 10})
    names = lambda *who: event_frame([(AT(20 * i), {**FAIL, "user_name": w}) for i, w in enumerate(who)])
    (a,) = detect(names("ana", "bo", "ana", "cy"), [rule]).collect()
    assert a.distinct_count == 3 and a.distinct["user_name"] == ["ana", "bo", "cy"]
    assert detect(names("ana", "bo", "ana", "bo", "ana"), [rule]).collect() == []
    assert detect(names("ana", "", None, "bo"), [rule]).collect() == []


def test_beacon_needs_regular_gaps(event_frame):
    call = {"event_dataset": "proxy", "network_direction": "outbound", "process_name": "sync-agent",
            "source_ip": "10.44.0.9", "destination_domain": "telemetry.test"}
    even = [(AT(31 * i), call) for i in range(50)]
    (a,) = run(event_frame(even), "SOC-C2-023")
    assert a.baseline.cov == 0 and a.baseline.interval_mean_s == 31
    steps, t = [], 0
    for i in range(50):
        t += 5 if i % 3 else 83
        steps.append((AT(t), call))
    assert run(event_frame(steps), "SOC-C2-023") == []


def test_sequence_edges(event_frame):
    rule = {"id": "own", "condition": {"event.action": "successful-logon"}, "requires": {
        "condition": {"event.action": "failed-logon"}, "min_count": 2, "window_minutes": 4,
        "key_fields": ["user.name"]}}
    fires = lambda *rows: [a.prior_events for a in detect(event_frame(list(rows)), [rule]).collect()]
    two = [(AT(0), FAIL), (AT(60), FAIL)]
    assert fires(*two, (AT(90), OK)) == [2]
    assert fires(*two, (AT(240), OK)) == [2]              # a prior exactly a window before counts
    assert fires(*two, (AT(241), OK)) == []
    assert fires(*two, (AT(90), {**OK, "user_name": "other"})) == []
    assert fires((AT(90), OK)) == []


def test_shipped_sequence(event_frame):
    priors = [(AT(45 * i), FAIL) for i in range(20)]
    (a,) = run(event_frame(priors + [(AT(1000), OK)]), "SOC-LOGIN-003")
    assert a.prior_events == 20


def test_sequence_without_keys_is_one_group(event_frame):
    rule = {"id": "g", "condition": {"event.action": "successful-logon"},
            "requires": {"condition": {"event.action": "failed-logon"}, "min_count": 1, "window_minutes": 5}}
    got = detect(event_frame([(AT(0), FAIL), (AT(50), {**OK, "source_ip": "9.9.9.9"})]), [rule]).collect()
    assert len(got) == 1


def test_travel_between_known_places(event_frame, spark):
    from secframe.plans.settings import geo_prefixes
    places = [r for r in geo_prefixes(spark).collect() if r.lat is not None and r.lat != 0]
    one = places[0]
    far = max(places, key=lambda p: abs(p.lon - one.lon))
    address = lambda p: str(ipaddress.IPv4Address(p.network + 9))
    here, there = ({**OK, "user_name": "rover", "source_ip": address(p)} for p in (one, far))
    (a,) = run(event_frame([(AT(0), here), (AT(900), there)]), "SOC-IMPTVL-005")
    assert a.geo["from"] == one.label and a.geo.to == far.label and a["count"] == 2
    assert run(event_frame([(AT(0), here), (AT(900), {**there, "user_name": "someone"})]), "SOC-IMPTVL-005") == []
    assert run(event_frame([(AT(0), here), (AT(0), there)]), "SOC-IMPTVL-005") == []


def test_no_rules_no_alerts(event_frame):
    assert detect(event_frame([(AT(0), FAIL)]), []).collect() == []


def test_alert_ids_do_not_depend_on_the_order_of_rules(event_frame):
    x = own_rule(threshold={"field": "source.ip", "min_events": 2, "window_minutes": 5})
    y = {**own_rule(), "id": "each"}
    events = event_frame([(AT(0), FAIL), (AT(7), FAIL)])
    ids = lambda *rules: {(a.rule_id, a.alert_id) for a in detect(events, list(rules)).collect()}
    assert ids(x, y) == ids(y, x) and len(ids(x, y)) == 2


def test_single_event_and_evidence_limits(event_frame):
    rows = [(f"3:0:{i % 60}", {"event_dataset": "web", "url_path": "/gate.php", "source_ip": "1.2.3.4",
                               "network_bytes": 10 + i}) for i in range(30)]
    (a,) = run(event_frame(rows), "SOC-C2-021")
    assert a["count"] == 30 and a.repeat_count == 30 and a.sample[0].text == "/gate.php"
    rule = {"id": "t", "condition": {"url.path": "/gate.php"}, "threshold": {"field": "source.ip", "min_events": 5}}
    (b,) = detect(event_frame(rows), [rule]).collect()
    assert b.entities["network_bytes"] == [str(10 + i) for i in range(12)] and len(b.sample) == 6


@pytest.mark.parametrize("seed", [1, 2])
def test_cooldown_against_greedy_walk(spark, seed):
    rnd = random.Random(seed)
    pts = {(k, w, rnd.randrange(4000)) for k, w, n in (("hot", 10, 900), ("b", 25, 120), ("c", 10, 5))
           for _ in range(n)}
    df = spark.createDataFrame(sorted(pts), "k string, w bigint, t bigint")
    got = {(r.k, r.t) for r in cooldown(df, ["k"], "t", F.col("w"), {10, 25}).collect()}
    want, last = set(), {}
    for k, w, t in sorted(pts, key=lambda p: p[2]):
        if k not in last or t - last[k] > w:
            last[k] = t
            want.add((k, t))
    assert got == want


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    nodes = [f"n{i:03d}" for i in range(300)]
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)]          # one long chain
    edges += [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(90)]
    edges += [("n299", n) for n in nodes[200:260]]                        # one hub
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = connected_components(spark.createDataFrame(edges, "a string, b string"),
                               spark.createDataFrame([(n,) for n in nodes], "node string")).collect()
    assert {r.node: r.component for r in got} == {n: find(n) for n in nodes}


def test_skew_helpers(spark):
    rnd = random.Random(5)
    rows = [("hot" if i % 3 else "cold", rnd.randrange(100), rnd.randrange(10_000), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, score int, t bigint, id int").withColumn(
        "bin", F.floor(F.col("t") / 1000))
    order = [F.col("t"), F.col("id")]
    got = {r.id: r.prev for r in previous_in_order(df, ["k"], [("score", True), ("bin", False)], order,
                                                   F.col("id"), "prev").collect()}
    want = {}
    for k in ("hot", "cold"):
        ids = [r[3] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2], r[3]))]
        want.update(dict(zip(ids, [None, *ids])))
    assert got == want
    ranks = {r.id: r.rank for r in global_rank(df, [("score", True), ("bin", False)], order, "rank").collect()}
    everyone = [r[3] for r in sorted(rows, key=lambda r: (-r[1], r[2], r[3]))]
    assert ranks == {i: n + 1 for n, i in enumerate(everyone)}
    import statistics
    assert exact_median(df, "t", 500).first().median == statistics.median(r[2] for r in rows)
    own = time_slices(df, "t", back=40, forward=20).filter("own")
    assert own.count() == len(rows)


def test_sketches_stay_within_their_error(spark):
    from secframe.operators.threshold import LG_K, distinct_sketches, merge_sketches
    rows = spark.range(300_000).selectExpr("0 AS rule_ix", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 50 AS STRING) END AS key", "0L AS bucket",
                                           "id AS t", "CAST(xxhash64(id) % 40000 AS STRING) AS dval", "id % 4 AS slice")
    parts = [distinct_sketches(rows.filter(f"slice = {i}")) for i in range(4)]
    merged = merge_sketches(parts[0].union(parts[1]).union(parts[2]).union(parts[3]))
    got = {r.key: (r.observed, r.n) for r in merged.select("key", "observed", F.hll_sketch_estimate("sketch").alias("n")).collect()}
    want = rows.groupBy("key").agg(F.count(F.lit(1)).alias("o"), F.count_distinct("dval").alias("n")).collect()
    error = 1.04 / 2 ** (LG_K / 2)
    assert all(got[r.key][0] == r.o and abs(got[r.key][1] - r.n) <= 4 * error * r.n for r in want) and len(want) > 40
