"""IP addresses as Columns: numeric form, CIDR tests, internal/external."""
from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

from secframe.functions.values import any_of

# fixed values: networks treated as internal (documentation ranges stay external on purpose)
INTERNAL_NETS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8",
                 "169.254.0.0/16", "::1/128", "fe80::/10", "fc00::/7")

_V4 = (r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$")


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` (keeps nested expressions small)."""
    return F.transform(F.array(value), use).getItem(0)


def ipv4_number(ip: Column) -> Column:
    """Dotted quad -> bigint, null when it is not a valid IPv4 address."""
    text = F.trim(ip)
    number = F.aggregate(F.split(text, r"\."), F.lit(0).cast("bigint"),
                         lambda acc, octet: acc * 256 + octet.cast("bigint"))
    return F.when(text.rlike(_V4), number)


def _groups(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


def _quad_to_groups(text: Column) -> Column:
    """``::ffff:1.2.3.4`` -> ``::ffff:102:304``."""
    tail = F.substring_index(text, ":", -1)
    quad = ipv4_number(tail)
    return F.when(quad.isNotNull(), F.lower(F.concat(
        F.substring(text, F.lit(1), F.length(text) - F.length(tail)),
        F.hex(F.call_function("div", quad, F.lit(65536))), F.lit(":"),
        F.hex(quad % 65536)))).otherwise(text)


def _assemble(p: Column) -> Column:
    head, rest, gap = p["head"], p["rest"], p["gap"]
    n = F.size(head) + F.size(rest)
    filled = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n)), rest)
    fits = F.when(gap == 1, n <= 7).when(gap == 0, n == 8).otherwise(F.lit(False))
    plain = F.forall(filled, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    return F.when(fits & plain, F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), ""))


def ipv6_hex(ip: Column) -> Column:
    """IPv6 text -> 32 hex digits (sortable), null when invalid."""
    def parts(text: Column) -> Column:
        gap = F.size(F.split(text, "::")) - 1
        before = F.split_part(text, F.lit("::"), F.lit(1))
        after = F.split_part(text, F.lit("::"), F.lit(2))
        return F.struct(_groups(F.when(gap > 0, before).otherwise(text)).alias("head"),
                        _groups(after).alias("rest"), gap.alias("gap"))
    text = F.lower(F.trim(ip))
    return F.when(text.contains(":"), _bind(_quad_to_groups(text), lambda s: _bind(
        parts(s), _assemble)))


def in_networks(ip: Column, cidrs) -> Column:
    """Is ``ip`` inside any of the literal CIDR blocks?  Null for an address that does not parse.

    Unparseable blocks are skipped; range bounds are computed once on the driver.
    """
    v4, v6 = [], []
    for cidr in cidrs:
        try:
            net = ipaddress.ip_network(str(cidr), strict=False)
        except ValueError:
            continue
        (v4 if net.version == 4 else v6).append(
            (int(net.network_address), int(net.broadcast_address)))
    within = lambda x, bounds: F.when(x.isNotNull(), any_of(x.between(lo, hi) for lo, hi in bounds))
    hexed = [(f"{lo:032x}", f"{hi:032x}") for lo, hi in v6]
    return (F.when(ip.contains(":"), _bind(ipv6_hex(ip), lambda h: within(h, hexed)))
            .otherwise(_bind(ipv4_number(ip), lambda n: within(n, v4))))


def is_internal(ip: Column) -> Column:
    return in_networks(ip, INTERNAL_NETS)


def address_key(ip: Column) -> Column:
    """Address of either family as sortable text: its family and its hex digits; null when invalid."""
    v4 = _bind(ipv4_number(ip), lambda n: F.concat(F.lit("4"), F.lower(F.lpad(F.hex(n), 8, "0"))))
    v6 = _bind(ipv6_hex(ip), lambda h: F.concat(F.lit("6"), h))
    return F.when(ip.contains(":"), v6).otherwise(v4)


def range_of(cidr: Column) -> Column:
    """``address/length`` -> struct of the first and last key of the block; host bits are ignored."""
    def block(p: Column) -> Column:
        key, bits = p["key"], p["bits"]
        size = (F.length(key) - 1) * 4
        whole, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
        head = F.substring(key, F.lit(1), whole + 1)
        digit = F.conv(F.substring(key, whole + 2, F.lit(1)), 16, 10).cast("int")
        step = F.element_at(F.array(F.lit(16), F.lit(8), F.lit(4), F.lit(2)), rest + 1)
        low = F.when(rest > 0, F.lower(F.hex((digit - digit % step).cast("bigint")))).otherwise("")
        high = F.when(rest > 0, F.lower(F.hex((digit - digit % step + step - 1).cast("bigint")))).otherwise("")
        fits = key.isNotNull() & (bits >= 0) & (bits <= size)
        return F.when(fits, F.struct(F.rpad(F.concat(head, low), F.length(key), F.lit("0")).alias("lo"),
                                     F.rpad(F.concat(head, high), F.length(key), F.lit("f")).alias("hi")))
    address = F.trim(F.split_part(cidr, F.lit("/"), F.lit(1)))
    key = address_key(address)
    given = F.split_part(cidr, F.lit("/"), F.lit(2))
    bits = F.when(given == "", F.when(address.contains(":"), 128).otherwise(32)).otherwise(given.try_cast("int"))
    return _bind(F.struct(key.alias("key"), bits.alias("bits")), block)
