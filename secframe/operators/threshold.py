"""Tumbling thresholds, plain and on distinct values."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from secframe.functions.match import Fields
from secframe.functions.values import floor_div, micros
from secframe.operators.hits import key_by_rule, literal_by_rule


def origin_of(events: DataFrame) -> Column:
    """Earliest event of the whole input, as a scalar subquery (one number, no join)."""
    return events.agg(F.min(micros(F.col("ts")))).scalar()


def distinct_value(hits: DataFrame, rules) -> Column:
    """The value whose variety the rule counts, null where it is missing or the rule counts none."""
    resolver = Fields(hits)
    dval = F.lit(None).cast("string")
    for i, r in enumerate(rules):
        if r.threshold.get("distinct_field"):
            text = resolver.resolve(r.threshold["distinct_field"])[0].cast("string")
            dval = F.when(F.col("rule_ix") == i, F.when(text != "", text)).otherwise(dval)
    return dval


def distinct_limits(rules) -> list:
    return [int(r.threshold.get("min_distinct", 1)) if r.threshold.get("distinct_field") else 0
            for r in rules]


def tumbling_buckets(hits: DataFrame, rules, origin: Column) -> DataFrame:
    """Threshold hits with their group ``key``, ``bucket`` and the rule's distinct value."""
    spans = [r.span_micros("threshold") if r.threshold else 1 for r in rules]
    dval = distinct_value(hits, rules)
    mine = [i for i, r in enumerate(rules) if r.mode == "threshold"]
    rows = hits.filter(~F.col("is_prior") & F.col("rule_ix").isin(mine))
    return rows.select(
        "*", F.coalesce(key_by_rule(hits, rules, "threshold"), F.lit("?")).alias("key"),
        floor_div(F.col("t") - origin, literal_by_rule(spans, "bigint")).alias("bucket"),
        dval.alias("dval"))


#: Sketches of 2^12 registers: a standard error of about 1.6 %, a few kilobytes at most.
LG_K = 12


def distinct_sketches(bucketed: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Counts and a sketch of distinct values per group: rows that can be stored and merged later.

    One row per (rule, key, bucket), so slices or batches of events can be summed up on their own.
    """
    return bucketed.groupBy("rule_ix", "key", "bucket").agg(
        F.count(F.lit(1)).alias("observed"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.hll_sketch_agg("dval", lg_k).alias("sketch"))


def merge_sketches(parts: DataFrame) -> DataFrame:
    """Stored rows of several slices as one row per group."""
    return parts.groupBy("rule_ix", "key", "bucket").agg(
        F.sum("observed").alias("observed"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"),
        F.hll_union_agg("sketch").alias("sketch"))


def groups_of_sketches(parts: DataFrame, rules) -> DataFrame:
    """Groups at or above their rule's limits, by the estimated number of distinct values."""
    merged = merge_sketches(parts).withColumn("distinct_count", F.hll_sketch_estimate("sketch")).drop("sketch")
    least = literal_by_rule([int(r.threshold.get("min_events", 1)) for r in rules], "bigint")
    return merged.filter((F.col("observed") >= least) & (F.col("distinct_count") >= literal_by_rule(distinct_limits(rules), "bigint")))


def threshold_groups(bucketed: DataFrame, rules) -> DataFrame:
    """Groups at or above their rule's limits: counts combine on the map side.

    Distinct values are counted exactly; ``groups_of_sketches`` is the approximate way.
    """
    least = [int(r.threshold.get("min_events", 1)) for r in rules]
    distinct = distinct_limits(rules)
    keys = ["rule_ix", "key", "bucket"]
    aggs = [F.count(F.lit(1)).alias("observed"), F.min("t").alias("first_t"),
            F.max("t").alias("last_t")]
    if any(distinct):
        aggs.append(F.count_distinct("dval").alias("distinct_count"))
        groups = bucketed.groupBy(*keys).agg(*aggs)
        wanted = F.col("distinct_count") >= literal_by_rule(distinct, "bigint")
    else:
        groups = bucketed.groupBy(*keys).agg(*aggs).withColumn(
            "distinct_count", F.lit(0).cast("bigint"))
        wanted = F.lit(True)
    return groups.filter((F.col("observed") >= literal_by_rule(least, "bigint")) & wanted)
