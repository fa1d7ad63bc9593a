"""Impossible travel: consecutive geolocated hits of a key that are too far apart."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from secframe.functions.match import Fields
from secframe.operators.geo import locate
from secframe.operators.hits import key_by_rule, literal_by_rule
from secframe.operators.skew import time_slices

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def consecutive_moves(points: DataFrame, keys, span: Column, longest: int, payload) -> DataFrame:
    """Each consecutive pair of points of a key with 0 < dt <= span: ``a``, ``b``, minutes, km.

    ``points`` carries bigint ``t``, ``event_seq``, ``lat`` and ``lon``.  Points of one instant
    never pair, so only the first and last of an instant can belong to a pair; that bounds the
    rows per key and slice before the window runs.
    """
    row = F.struct("t", "event_seq", "lat", "lon", *payload)
    instants = points.groupBy(*keys, "t").agg(F.min_by(row, "event_seq").alias("head"),
                                              F.max_by(row, "event_seq").alias("tail"))
    w = Window.partitionBy(*keys, "slice").orderBy("t")
    pairs = (time_slices(instants, "t", back=longest)
             .withColumn("a", F.lag("tail").over(w)).withColumn("b", F.col("head"))
             .filter("own"))
    gap = F.col("b.t") - F.col("a.t")
    km = haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return (pairs.filter((gap > 0) & (gap <= span))
            .select(*keys, "a", "b", (gap / 60_000_000.0).alias("minutes"), km.alias("km")))


def first_moves(hits: DataFrame, rules, prefixes: DataFrame) -> DataFrame:
    """First implausible move per (rule, key): pair ``a``/``b``, minutes, km, km/h."""
    mine = {i: r for i, r in enumerate(rules) if r.mode == "travel"}
    resolver = Fields(hits)
    ip = F.lit(None).cast("string")
    for i, r in mine.items():
        field = r.window.get("geo_field", "source.ip")
        ip = F.when(F.col("rule_ix") == i, resolver.resolve(field)[0]).otherwise(ip)
    rows = (hits.filter(~F.col("is_prior") & F.col("rule_ix").isin(list(mine)))
            .withColumn("key", F.coalesce(key_by_rule(hits, rules, "travel"), F.lit("?")))
            .withColumn("geo_ip", ip))
    places = locate(rows.select(F.col("geo_ip").alias("ip")), prefixes)
    located = (rows.join(places.filter(F.col("lat").isNotNull())
                         .select(F.col("ip").alias("geo_ip"), "label", "lat", "lon"), "geo_ip"))
    spans = [r.span_micros("travel") if i in mine else 0 for i, r in enumerate(rules)]
    far = [float(r.window.get("min_distance_km", 400)) if i in mine else 0.0
           for i, r in enumerate(rules)]
    payload = [c for c in hits.columns if c not in
               ("rule_ix", "is_prior", "t", "event_seq", "lat", "lon", "label")] + ["label"]
    moves = consecutive_moves(located, ["rule_ix", "key"], literal_by_rule(spans, "bigint"),
                              max(spans), payload)
    moves = moves.filter(F.col("km") >= literal_by_rule(far, "double"))
    whole = F.struct("a", "b", "minutes", "km")
    return (moves.groupBy("rule_ix", "key").agg(F.min_by(whole, F.col("b.t")).alias("m"))
            .select("rule_ix", "key", "m.*")
            .withColumn("kmh", F.col("km") / (F.col("minutes") / 60.0)))
