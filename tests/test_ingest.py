from pyspark.sql import functions as F

from secframe.sources.registry import (SOURCES, good_events, ingest_loss, parse_lines, read_events,
                                       read_sources, write_events)

FW = "@timestamp,action,src_ip,src_port,dst_ip,dst_port,bytes,proto,rule,host,dst_domain"


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_apache(spark):
    df = parse_lines(lines(
        spark, '203.0.113.44 - m.kumar [02/Sep/2026:08:50:01 +0530] "POST /OWA/auth.owa HTTP/1.1" 401 900 "-" "curl/8"\r',
        "junk", "", '1.2.3.4 - - [02/Sep/2026:08:50:01 +0530] "GET /A" 200 -'), SOURCES["web"], "web")
    a, b = good_events(df).orderBy("event_seq").collect()
    assert (a.source_ip, a.http_response_status_code, a.url_path, a.user_name) == (
        "203.0.113.44", 401, "/owa/auth.owa", "m.kumar")
    assert str(a.ts) == "2026-09-02 03:20:01" and a.event_outcome == "failure" and a.web_auth_failure
    assert (b.network_bytes, b.user_name, b.event_outcome) == (0, None, "success")
    loss = ingest_loss(df).first()
    assert (loss.lines, loss.parsed, loss.parse_errors) == (4, 2, 1)


def test_syslog(spark):
    df = parse_lines(lines(
        spark, "Sep  2 09:00:01 linux-prod-01 sshd[42]: action=authentication-failure outcome=failure "
        "user=root ip=45.155.205.10 rport=51222 method=password", "garbage",
        "Sep  2 09:00:02 h sshd[1]: Failed password for root from 1.2.3.4 port 22",
        'Sep  2 09:00:03 h cron: msg="a \\"b\\" c" x=1 x=2'), SOURCES["ssh"], "ssh")
    a, b, c = good_events(df).orderBy("ts").collect()
    assert (a.event_dataset, a.event_action, a.source_ip, a.source_port, a.logon_failure) == (
        "auth", "authentication-failure", "45.155.205.10", 51222, True)
    assert (b.event_action, b.source_ip) == ("authentication-failure", "1.2.3.4")
    assert c.event_action == "syslog-message" and c.extra == {"msg": 'a "b" c', "x": "2"}
    assert ingest_loss(df).first().parse_errors == 1


def test_json(spark):
    df = parse_lines(lines(
        spark, '{"@timestamp":"2026-09-02T03:20:00+00:00","event.dataset":"process_creation","EventID":1,'
        '"Computer":"WS-1","Image":"C:\\\\Win\\\\PowerShell.EXE","ParentImage":"C:\\\\x\\\\OUTLOOK.EXE",'
        '"CommandLine":"Run -X","ProcessId":5}', "[1]", "5", '{"a":1', '{"@timestamp":"zzz"}', " "),
        SOURCES["auth"], "auth")
    e = good_events(df).first()
    assert (e.process_name, e.process_parent, e.process_command_line, e.host_name) == (
        "powershell.exe", "outlook.exe", "run -x", "WS-1")
    assert "process-create" in e.tags and e.extra == {"ProcessId": "5"}
    loss = ingest_loss(df).first()
    assert (loss.lines, loss.parsed, loss.parse_errors) == (6, 1, 4)


def test_delimited(spark):
    full = "2026-09-02T08:20:00+0530,DENY,1.2.3.4,99,10.0.0.1,445,12,tcp,d,h,"
    df = parse_lines(lines(spark, FW, full, "2026-09-02T08:20:00+0530,ALLOW,,,,", full + ",", ""),
                     SOURCES["firewall"], "fw", header=FW)
    a, b = good_events(df).orderBy("event_seq").collect()
    assert (a.event_action, a.destination_port, a.destination_ip_not_private) == ("deny", 445, False)
    assert (b.event_action, b.source_ip) == ("allow", None)
    loss = ingest_loss(df).first()
    assert (loss.lines, loss.parsed, loss.parse_errors) == (5, 2, 1)


def test_registry_and_sink(spark, tmp_path):
    (tmp_path / "auth.log").write_text("Sep  2 09:00:01 h sshd[1]: action=x ip=1.2.3.4\n")
    (tmp_path / "firewall.csv").write_text(FW + "\n2026-09-02T08:20:00+0530,DENY,1.2.3.4,9,10.0.0.1,22,1,tcp,d,h,\n")
    records, missing = read_sources(spark, str(tmp_path))
    assert sorted(missing) == ["auth", "dns", "process", "proxy", "web"]
    events = good_events(records)
    out = str(tmp_path / "events")
    write_events(events, out)
    back = read_events(spark, out)
    assert back.count() == 2 and back.select("event_seq").distinct().count() == 2
    scan = back.filter(F.col("event_dataset") == "firewall")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "event_dataset" in scan.split("PartitionFilters")[1][:120]


def test_delimited_files_have_their_own_headers(spark, tmp_path):
    other = "action,@timestamp,src_ip"
    folder = tmp_path / "firewall.csv"
    folder.mkdir()
    row = "2026-09-02T08:20:%02d+0530,DENY,1.2.3.%d,9,10.0.0.1,22,1,tcp,d,h,"
    for f in range(3):
        (folder / f"part-{f}.csv").write_text(
            FW + "\n" + "\n".join(row % (i, f * 20 + i) for i in range(20)) + "\n")
    (folder / "part-9.csv").write_text("\n" + other + "\nALLOW,2026-09-02T09:00:00+0530,9.9.9.9\n")
    records, _ = read_sources(spark, str(tmp_path))
    events = good_events(records).orderBy("event_seq").collect()
    assert [e.source_ip for e in events] == [f"1.2.3.{i}" for i in range(60)] + ["9.9.9.9"]
    loss = ingest_loss(records).first()
    assert (loss.lines, loss.parsed, loss.parse_errors) == (66, 61, 0)


def test_json_lines_are_whole_objects(spark):
    good = '{"@timestamp":"2026-09-02T03:20:00+00:00","event.action":"x"}'
    df = parse_lines(lines(spark, good, good + " tail}", good + good, good + "," + good,
                           good.replace('"', "'")), SOURCES["auth"], "auth")
    loss = ingest_loss(df).first()
    assert (loss.lines, loss.parsed, loss.parse_errors) == (5, 1, 4)


def test_json_lists_and_vendor_fields(spark):
    from secframe.functions.match import Fields, compile_condition
    df = parse_lines(lines(
        spark, '{"@timestamp":"2026-09-02T03:20:00+00:00","event.action":["failed-logon","x"],"EventID":"4625","User":"u1","tags":["a"],"ports":[1,2]}',
        '{"@timestamp":"2026-09-02T03:20:01+00:00","event.action":"plain","user.name":[],"a":1,"a":2}',
        '{"@timestamp":"2026-09-02T03:20:02+00:00"}] [{"x":1}', '{"a":[{"b":1}]}] [{"x":1}'), SOURCES["auth"], "auth")
    assert ingest_loss(df).first().parse_errors == 2
    ev = good_events(df).orderBy("ts")
    a, b = ev.collect()
    assert a.lists == {"event.action": ["failed-logon", "x"], "tags": ["a"], "ports": ["1", "2"]} and a.tags == ["a", "eventcode/4625"]
    assert a.vendor == {"EventID": "4625", "User": "u1"} and b.user_name is None and b.extra == {"a": "2"}
    match = lambda c: [r.event_action for r in ev.filter(compile_condition([c], Fields(ev))).collect()]
    assert match({"event.action": "X"}) == match({"event.action": {"all": ["x", "failed-logon"]}}) == match({"ports": "2"}) == [a.event_action]
    assert match({"event.action": {"all": ["x", "y"]}}) == match({"event.action": {"equals": "x"}}) == []
    assert match({"EventID": "4625", "User": "U1"}) == [a.event_action] and match({"event.action": "plain"}) == ["plain"]


def test_a_new_vendor_needs_no_code(spark):
    from secframe.functions.match import Fields, compile_condition
    from secframe.sources.registry import alias_tables, with_aliases
    table = spark.createDataFrame([("Acme", "srcAddr", "source.ip", 1), ("Acme", "login", "user.name", 2), ("Acme", "acct", "user.name", 1)],
                                  "source_type string, vendor string, field string, rank int")
    sources = with_aliases({"acme": {"file": "x", "type": "jsonl", "source_type": "Acme", "dataset": "vpn"}, **SOURCES}, alias_tables(table))
    assert "aliases" not in sources["auth"]
    df = parse_lines(lines(spark, '{"@timestamp":"2026-09-02T03:20:00Z","srcAddr":"203.0.113.5","login":"zoe","acct":"-","other":"1"}',
                           '{"@timestamp":"2026-09-02T03:20:01Z","acct":"amy","login":"zoe"}'), sources["acme"], "acme")
    ev = good_events(df).orderBy("ts")
    a, b = ev.collect()
    assert (a.source_ip, a.user_name, a.source_ip_not_private, a.extra, b.user_name) == ("203.0.113.5", "zoe", True, {"other": "1"}, "amy")
    assert ev.filter(compile_condition([{"srcAddr": "203.0.113.5", "login": "ZOE"}], Fields(ev))).count() == 1
    import pytest
    with pytest.raises(ValueError, match="no canonical field"):
        alias_tables(spark.createDataFrame([("Acme", "a", "no.such")], "source_type string, vendor string, field string"))


def test_sink_splits_a_large_folder_and_compacts_small_files(spark, tmp_path):
    from secframe.sources.normalize import conform
    from secframe.sources.registry import compact_events
    import glob
    import os
    rows = spark.range(60_000).selectExpr("id AS event_seq", "timestamp_seconds(1767225600 + id % 80000) AS ts",
                                          "CASE WHEN id % 10 = 0 THEN 'dns' ELSE 'web' END AS event_dataset", "sha2(CAST(id AS STRING), 512) AS event_original")
    sizes = lambda p, d: [os.path.getsize(f) for f in glob.glob(f"{p}/event_date=*/event_dataset={d}/*.parquet")]
    out, old = str(tmp_path / "e"), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        write_events(conform(rows), out)
        web = sizes(out, "web")
        assert len(web) >= 4 and max(web) < 3 * min(web) and len(sizes(out, "dns")) <= 3
        for i in range(5):
            write_events(conform(rows.filter(f"event_seq % 5 = {i}").withColumn("event_dataset", F.lit("late"))), out)
        before = len(sizes(out, "late"))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
        compact_events(spark, out)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert before >= 5 and len(sizes(out, "late")) == 1
    assert read_events(spark, out).count() == 120_000
