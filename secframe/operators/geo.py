"""Geolocation by address ranges of both families, the narrowest range first, as one equi-join."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from secframe.functions.net import address_key, is_internal, range_of
from secframe.operators.skew import global_rank
from secframe.session import materialize

#: Hex digits of an address that buckets are named by: every second one, per family.
_LEVELS = {"4": range(0, 9, 2), "6": range(0, 33, 2)}


def range_table(ranges: DataFrame) -> DataFrame:
    """Rows with ``cidr``, or ``first_ip`` and ``last_ip``, as ranges of address keys with their bucket.

    A range lies in the bucket of the leading digits that both its ends share (an even number of
    them).  So it is stored once, and a bucket holds only ranges that cross one of the 255 borders
    between its sub-buckets: a few hundred at most, times the depth to which ranges overlap.
    Ranges that do not parse are left out.
    """
    if "cidr" in ranges.columns:
        both = range_of(F.col("cidr"))
        lo, hi = both["lo"], both["hi"]
    else:
        lo, hi = address_key(F.col("first_ip")), address_key(F.col("last_ip"))
    df = ranges.select(*[c for c in ranges.columns if c not in ("cidr", "first_ip", "last_ip")], lo.alias("lo"), hi.alias("hi"))
    df = df.filter(F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.length("lo") == F.length("hi")) & (F.col("lo") <= F.col("hi")))
    shared = F.aggregate(F.sequence(F.lit(2), F.length("lo")), F.lit(1), lambda n, i: F.when(
        (n == i - 1) & (F.substring(F.col("lo"), F.lit(1), i) == F.substring(F.col("hi"), F.lit(1), i)), i).otherwise(n))
    return df.withColumn("bucket", F.substring(F.col("lo"), F.lit(1), shared - (shared + 1) % 2))


def buckets_of(key: Column) -> Column:
    """All buckets that can hold a range around an address: one per level of its family."""
    names = lambda family: F.array(*[F.substring(key, 1, 1 + n) for n in _LEVELS[family]])
    return F.when(key.startswith("4"), names("4")).otherwise(names("6"))


def ranked_ranges(ranges: DataFrame) -> DataFrame:
    """The different ranges (bucket, lo, hi, g) with a ``rank``: of two around an address the narrower one is later.

    Ranges with the same ends are one, with the first label, however often a feed names them.
    """
    different = ranges.groupBy("bucket", "lo", "hi").agg(F.min(F.struct("label", "lat", "lon", "category", "prefix_len")).alias("g"))
    start = F.substring("lo", 1, 5)
    return global_rank(different.withColumn("start", start), [("start", False)], [F.col("lo"), F.desc("hi")], "rank").drop("start")


def locate(ips: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Distinct ``ip`` -> label, lat, lon, category, prefix_len, internal; the narrowest range wins.

    Of nested ranges that is the one that starts last and ends first; ``prefix_len`` is null for
    ranges that were not given as blocks.  Nothing is collected: an address meets the buckets of all
    levels of its family (five or seventeen) in one join, whatever is in the feed, and of the ranges
    around it only the highest rank is kept.
    """
    ips = ips.select("ip").filter(F.col("ip").isNotNull()).distinct()
    ranges = range_table(prefixes)
    if "prefix_len" not in ranges.columns:
        ranges = ranges.withColumn("prefix_len", F.lit(None).cast("int"))
    ranges = materialize(ranked_ranges(ranges), "ranges")
    keyed = ips.withColumn("key", address_key(F.col("ip"))).filter(F.col("key").isNotNull())
    probes = keyed.select("ip", "key", F.explode(buckets_of(F.col("key"))).alias("bucket"))
    inside = probes.join(ranges.select("bucket", "lo", "hi", "rank"), "bucket").filter((F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi")))
    found = inside.groupBy("ip").agg(F.max("rank").alias("rank")).join(ranges.select("rank", "g"), "rank").drop("rank")
    return (ips.join(found, "ip", "left")
            .select("ip", F.coalesce("g.label", F.when(is_internal(F.col("ip")), "private range"))
                    .alias("label"), "g.lat", "g.lon", "g.category", "g.prefix_len",
                    is_internal(F.col("ip")).alias("internal")))
