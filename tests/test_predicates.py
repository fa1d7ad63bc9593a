import pytest
from pyspark.sql import functions as F

from secframe.functions.match import Fields, compile_clause, compile_condition
from secframe.functions.net import ipv6_hex, is_internal
from secframe.plans.rulepack import RULES
from secframe.plans.rules import load_rules, repeated_rule_ids, rules_frame


@pytest.fixture(scope="module")
def row(spark):
    return spark.sql("""SELECT 5000L AS network_bytes, '/a/b%c' AS url_path, '1.2.3.4' AS source_ip,
        array('failed-logon') AS event_action, array('sysmon/1') AS tags, CAST(NULL AS STRING) AS user_name,
        true AS logon_failure, map('odd.field', 'Yes') AS extra""")


@pytest.mark.parametrize("field, spec, want", [
    ("event.action", ["deny", "Failed-Logon"], True), ("event.action", ["allow"], False),
    ("tags", ["sysmon/1", "x"], True), ("tags", ["SYSMON/1"], False),
    ("network.bytes", {"gte": 2500}, True), ("network.bytes", {"gt": 5000}, False),
    ("network.bytes", {"gte": 1, "lt": 5000}, False), ("url.path", {"gt": 1}, False),
    ("url.path", {"wildcard": "/A/*"}, True), ("url.path", {"wildcard": "*b%c"}, True),
    ("url.path", {"wildcard": "*b_c"}, False), ("url.path", {"regex": "^/a/"}, True),
    ("missing.field", {"exists": False}, True), ("missing.field:exists", None, False),
    ("source.ip", {"cidr": ["1.0.0.0/8"]}, True), ("source.ip", {"cidr": ["nonsense"]}, False),
    ("user.name", {"equals": "none"}, False), ("user.name", {"regex": "."}, False),
    ("logon.failure", True, True), ("logon.failure", False, False),
    ("odd.field", "yes", True), ("event.action", {"all": ["failed-logon"]}, True),
    ("event.action", {"all": ["failed-logon", "x"]}, False), ("url.path", {"all": ["/a/b%c"]}, False),
    ("@any_of", [{"user.name": "x"}, {"network.bytes": 5000}], True),
    ("@all", [{"user.name": "x"}, {"network.bytes": 5000}], False),
])
def test_clause(row, field, spec, want):
    assert (row.filter(compile_clause(field, spec, Fields(row))).count() == 1) is want


def test_unknown_operator_and_empty_condition(row):
    with pytest.raises(ValueError, match="unknown operator"):
        compile_clause("url.path", {"near": 1}, Fields(row))
    assert row.filter(compile_condition([], Fields(row))).count() == 0


def test_internal_addresses(spark):
    want = {"10.10.31.27": True, "192.168.1.5": True, "172.31.0.1": True, "172.32.0.1": False,
            "203.0.113.44": False, "198.51.100.23": False, "192.0.2.1": False, "::1": True,
            "fe80::1": True, "fd00::12": True, "2001:db8::1": False, "300.1.1.1": None, "x": None,
            "1::2::3": None, "01.2.3.4": None}
    df = spark.createDataFrame([(k,) for k in want], "ip string")
    got = {r.ip: r.i for r in df.select("ip", is_internal(F.col("ip")).alias("i")).collect()}
    assert got == want


def test_ipv6_digits(spark):
    df = spark.createDataFrame([("::ffff:10.0.0.1",), ("1:2:3:4:5:6:7:8",)], "ip string")
    assert [r[0] for r in df.select(ipv6_hex(F.col("ip"))).collect()] == [
        "00000000000000000000ffff0a000001", "00010002000300040005000600070008"]


def test_rule_catalogue(spark):
    rules = load_rules(RULES)
    assert len(rules) == 29
    with pytest.raises(ValueError, match="SOC-BRUTE-001"):
        load_rules([*RULES, {"id": "SOC-BRUTE-001"}])
    frame = rules_frame(spark, rules)
    assert repeated_rule_ids(frame).count() == 0
    assert {r.mode for r in rules} == {"single", "threshold", "sequence", "travel", "beacon"}
    assert load_rules([{"id": "off", "enabled": False}]) == []


def test_every_pattern_compiles(spark):
    from secframe.schema import EVENT_SCHEMA
    empty = spark.createDataFrame([], EVENT_SCHEMA)
    for r in load_rules(RULES):
        assert empty.filter(r.hit(Fields(empty))).count() == 0
