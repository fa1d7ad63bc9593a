"""Machine-regular polling: densest window per key, then regularity of its intervals."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from secframe.functions.values import floor_div
from secframe.operators.hits import key_by_rule, literal_by_rule
from secframe.operators.skew import sliding_sum


#: Parts of a dense window that are summed up on their own.
PARTS = 64


def instants_of(hits: DataFrame, rules) -> DataFrame:
    mine = [i for i, r in enumerate(rules) if r.mode == "beacon"]
    return (hits.filter(~F.col("is_prior") & F.col("rule_ix").isin(mine))
            .withColumn("key", F.coalesce(key_by_rule(hits, rules, "beacon"), F.lit("?"))))


def densest_windows(instants: DataFrame, keys, span) -> DataFrame:
    """Earliest window of length <= span holding the most events, per key.

    ``instants`` is (keys, t, n) with one row per instant.  Returns keys, window_end, in_window.
    """
    counted = sliding_sum(instants, keys, "t", "n", span, "in_window")
    best = F.max(F.struct("in_window", (-F.col("t")).alias("minus_t"))).alias("best")
    return (counted.groupBy(*keys).agg(best)
            .select(*keys, (-F.col("best.minus_t")).alias("window_end"),
                    F.col("best.in_window").alias("in_window")))


def in_dense(rows: DataFrame, dense: DataFrame, keys, span) -> DataFrame:
    """Rows (keys, t) inside the dense window of their key.

    Windows name the one or two time cells of their length that they lie in, so a key meets only the
    rows of those cells, however long its history is.
    """
    cell = lambda t: floor_div(t, span)
    begin = F.col("window_end") - span
    reach = dense.select("*", begin.alias("window_start"), F.explode(F.array_distinct(F.array(cell(begin), cell(F.col("window_end"))))).alias("_cell"))
    near = rows.withColumn("_cell", cell(F.col("t"))).join(reach, [*keys, "_cell"])
    return near.filter((F.col("t") >= F.col("window_start")) & (F.col("t") <= F.col("window_end"))).drop("_cell")


def regularity(instants: DataFrame, dense: DataFrame, keys, span) -> DataFrame:
    """Mean, population deviation and variation of the intervals inside each dense window.

    A window is cut into ``PARTS`` parts.  Each part is summed up on its own (first, last, squares of
    its gaps), the parts of a key are then stitched together in order; no group is larger than a part.
    Simultaneous events are intervals of length zero and add nothing to the sums.
    """
    inside = in_dense(instants, dense, keys, span)
    part = floor_div(F.col("t") - F.col("window_start"), F.greatest(F.lit(1).cast("bigint"), floor_div(span, PARTS)))
    order = Window.partitionBy(*keys, "_part").orderBy("t")
    gap = (F.col("t") - F.lag("t").over(order)) / 1e6
    parts = inside.withColumn("_part", part).withColumn("_gap", gap).groupBy(*keys, "window_end", "in_window", "_part").agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.coalesce(F.sum(F.col("_gap") * F.col("_gap")), F.lit(0.0)).alias("squares"))
    stitched = parts.groupBy(*keys, "window_end", "in_window").agg(
        F.array_sort(F.collect_list(F.struct("_part", "first", "last", "squares"))).alias("p"))
    between = lambda x, i: F.when(i > 0, F.pow((x["first"] - F.get("p", i - 1)["last"]) / 1e6, F.lit(2.0))).otherwise(0.0)
    squares = F.aggregate(F.transform("p", lambda x, i: x["squares"] + between(x, i)), F.lit(0.0), lambda s, x: s + x)
    first, last = F.col("p")[0]["first"], F.element_at("p", -1)["last"]
    gaps = F.col("in_window") - 1
    mean = (last - first) / 1e6 / gaps
    stats = stitched.select(*keys, "window_end", "in_window", mean.alias("mean_s"), first.alias("first_t"),
                            F.sqrt(F.greatest(F.lit(0.0), squares / gaps - mean * mean)).alias("sd_s"))
    return stats.withColumn("cov", F.when(F.col("mean_s") > 0, F.col("sd_s") / F.col("mean_s")).otherwise(F.lit(99.0)))


def beacons(hits: DataFrame, rules) -> DataFrame:
    """Keys whose densest window is regular enough for their rule."""
    mine = {i: r for i, r in enumerate(rules) if r.mode == "beacon"}
    spans = [r.span_micros("beacon") if i in mine else 1 for i, r in enumerate(rules)]
    limit = lambda name, default: literal_by_rule(
        [float(r.config.get("time_stats", {}).get(name, default)) for r in rules], "double")
    least = literal_by_rule([int(r.config.get("threshold", {}).get("min_events", 10))
                             for r in rules], "bigint")
    keys = ["rule_ix", "key"]
    instants = instants_of(hits, rules).groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("n"))
    span = literal_by_rule(spans, "bigint")
    dense = densest_windows(instants, keys, span)
    dense = dense.filter((F.col("in_window") >= least) & (F.col("in_window") > 1))
    stats = regularity(instants, dense, keys, span)
    return stats.filter((F.col("cov") <= limit("max_cov", 1.0))
                        & (F.col("mean_s") >= limit("min_interval_s", 0))
                        & (F.col("mean_s") <= limit("max_interval_s", 1e9)))
