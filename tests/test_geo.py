import ipaddress
import random

from secframe.operators.geo import locate


def test_ranges_of_both_families(spark):
    rnd = random.Random(2)
    nets, ips = [], ["not an ip", "1.2.3", "::1", "fe80::1"]
    for i in range(300):
        if i % 2:
            base = (0x20010db8 << 96) + (rnd.randrange(4) << 90) + (rnd.randrange(2 ** 20) << 40) + rnd.randrange(2 ** 30)
            net = ipaddress.ip_network((base, rnd.randrange(16, 129)), strict=False)
        else:
            net = ipaddress.ip_network(((10 << 24) + rnd.randrange(2 ** 22), rnd.randrange(0 if i == 0 else 6, 33)), strict=False)
        nets.append(net)
        ips += [str(net[0]), str(net[-1]), str(net[rnd.randrange(min(net.num_addresses, 2 ** 40))])]
    rows = [(str(n), str(n), float(n.prefixlen), 0.0, None, n.prefixlen) for n in nets] + [("nonsense/8", "x", 0.0, 0.0, None, 8), ("10.0.0.0/99", "x", 0.0, 0.0, None, 9)]
    feed = spark.createDataFrame(rows, "cidr string, label string, lat double, lon double, category string, prefix_len int")
    got = {r.ip: r.label for r in locate(spark.createDataFrame([(i,) for i in ips], "ip string"), feed).collect()}
    for i in set(ips[4:]):
        a = ipaddress.ip_address(i)
        want = max((n for n in nets if n.version == a.version and a in n), key=lambda n: n.prefixlen)
        assert got[i] == str(want), i
    assert got["not an ip"] is None and got["1.2.3"] is None and got["::1"] == "private range"


def test_ranges_that_are_no_blocks(spark):
    feed = spark.createDataFrame([("9.255.255.200", "10.0.1.5", "across", 1.0), ("10.0.0.7", "10.0.0.9", "few", 2.0), ("10.0.0.9", "10.0.0.7", "backwards", 3.0)],
                                 "first_ip string, last_ip string, label string, lat double").selectExpr("*", "0D AS lon", "CAST(NULL AS STRING) AS category")
    asked = spark.createDataFrame([("10.0.0.8",), ("10.0.1.5",), ("9.255.255.255",), ("10.0.1.6",)], "ip string")
    got = {r.ip: r.label for r in locate(asked, feed).filter("lat IS NOT NULL").collect()}
    assert got == {"10.0.0.8": "few", "10.0.1.5": "across", "9.255.255.255": "across"}


def test_a_feed_that_repeats_its_ranges(spark):
    """Many spellings of one block are one range; of ranges deep in one another the innermost is found."""
    from secframe.operators.geo import range_table, ranked_ranges
    same = [(f"10.{i % 200}.{i // 200}.0/8", f"n{i:04d}", 8) for i in range(1500)]
    deepest = 600
    nested = [(f"2001:db8::{i:x}", f"2001:db8::{65535 - i:x}", f"r{i}") for i in range(deepest)]
    columns = "CAST(1 AS DOUBLE) AS lat", "CAST(2 AS DOUBLE) AS lon", "CAST(NULL AS STRING) AS category"
    feed = spark.createDataFrame(same, "cidr string, label string, prefix_len int").selectExpr("*", *columns)
    assert ranked_ranges(range_table(feed)).count() == 1
    (row,) = locate(spark.createDataFrame([("10.77.1.2",)], "ip string"), feed).collect()
    assert (row.label, row.prefix_len) == ("n0000", 8)
    deep = spark.createDataFrame(nested, "first_ip string, last_ip string, label string").selectExpr("*", *columns)
    asked = [0, 1, 300, deepest - 1, deepest + 5]
    got = {r.ip: r.label for r in locate(spark.createDataFrame([(f"2001:db8::{i:x}",) for i in asked], "ip string"), deep).collect()}
    assert got == {f"2001:db8::{i:x}": f"r{min(i, deepest - 1)}" for i in asked}
