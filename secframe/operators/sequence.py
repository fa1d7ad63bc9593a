"""Prior-event sequences with per-key cooldown."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from secframe.functions.values import floor_div
from secframe.operators.hits import key_by_rule, literal_by_rule
from secframe.operators.skew import first_k, sliding_sum, time_slices
from secframe.session import materialize


def sequence_rows(hits: DataFrame, rules) -> DataFrame:
    """Hits and priors of sequence rules with their group key."""
    mine = [i for i, r in enumerate(rules) if r.has_sequence]
    rows = hits.filter(F.col("rule_ix").isin(mine))
    return rows.withColumn("key", F.coalesce(key_by_rule(hits, rules, "sequence"), F.lit("?")))


def preceded(rows: DataFrame, rules) -> DataFrame:
    """Hit instants with at least ``min_count`` priors of the same key in [t - w, t].

    Rows are first counted per (rule, key, instant) on the map side; the sliding count then runs
    over instants inside time cells, so neither a busy instant nor a busy key makes a large
    group.  Returns (rule_ix, key, t, prior_events).
    """
    spans = {i: r.span_micros("sequence") for i, r in enumerate(rules) if r.has_sequence}
    least = [int(r.requires.get("min_count", 1)) if i in spans else 0 for i, r in enumerate(rules)]
    instants = rows.groupBy("rule_ix", "key", "t").agg(
        F.count_if(F.col("is_prior")).alias("priors"), F.count_if(~F.col("is_prior")).alias("n_hits"))
    span = literal_by_rule([spans.get(i, 0) for i in range(len(rules))], "bigint")
    seen = sliding_sum(instants, ["rule_ix", "key"], "t", "priors", span, "prior_events")
    return (seen.filter((F.col("n_hits") > 0) & (F.col("prior_events") >= literal_by_rule(least, "bigint")))
            .select("rule_ix", "key", "t", "prior_events"))


def cooldown(points: DataFrame, keys, t: str, span: Column, lengths) -> DataFrame:
    """Greedy per-key cooldown: after firing at f, points up to and including f + w are skipped.

    ``points`` must be distinct on (keys, t); ``span`` gives each row's w in the unit of ``t`` and
    ``lengths`` lists the values it can take.

    The greedy walk is cut into independent runs: a point with nothing in the w before it always
    fires.  From any fired point the next one is the first point after t + w, which either starts
    a run or lies within t + 2w; one pass back over points and ends finds it.  Fired points are then those
    reachable from run starts, found by pointer doubling: log2(longest run) rounds of joins on
    unique keys, with no per-key list anywhere.
    """
    lengths = sorted(lengths)
    keys = list(keys)
    at = [*keys, t]
    sliced = time_slices(points.withColumn("_w", span), t, back=max(lengths),
                         forward=2 * max(lengths) + 1)
    w = Window.partitionBy(*keys, "slice").orderBy(t)
    marked = sliced.withColumn("_start", F.coalesce(F.col(t) - F.lag(t).over(w) > F.col("_w"), F.lit(True)))
    # going back in time, the point last met before t + w is the first one after it
    asks = F.when(F.col("own"), F.struct((F.col(t) + F.col("_w")).alias("at"), F.lit(None).cast("struct<t:bigint,start:boolean>").alias("point")))
    stands = F.struct(F.col(t).alias("at"), F.struct(F.col(t).alias("t"), F.col("_start").alias("start")).alias("point"))
    line = marked.select(*at, "slice", "_w", "_start", F.explode(F.array_compact(F.array(stands, asks))).alias("_e"))
    back = Window.partitionBy(*keys, "slice").orderBy(F.desc("_e.at"), F.isnotnull("_e.point")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.last("_e.point", ignorenulls=True).over(back)
    linked = line.withColumn("_ahead", ahead).filter("_e.point IS NULL")
    hop = F.when(~F.col("_ahead.start") & (F.col("_ahead.t") - F.col(t) <= 2 * F.col("_w")), F.col("_ahead.t"))
    linked = linked.select(*at, "_start", hop.alias("_to"))
    linked = materialize(linked, "cooldown-links")
    fired = linked.filter("_start").select(*at)
    jumps = linked.filter(F.col("_to").isNotNull()).select(*at, "_to")
    # points that no run start can reach still have links; they only matter as stepping stones
    while True:
        step = fired.join(jumps, at).select(*keys, F.col("_to").alias(t))
        step = materialize(step, "cooldown-step")
        if step.isEmpty():
            return points.join(fired, at, "left_semi")
        fired = fired.unionByName(step)
        far = jumps.select(*keys, F.col(t).alias("_to"), F.col("_to").alias("_far"))
        jumps = jumps.join(far, [*keys, "_to"]).select(*at, F.col("_far").alias("_to"))
        jumps = materialize(jumps, "cooldown-jumps")


def fired_sequences(rows: DataFrame, rules) -> DataFrame:
    """Sequence firings after cooldown: (rule_ix, key, t, prior_events)."""
    qualifying = materialize(preceded(rows, rules), "sequence-qualifying")
    spans = {i: r.span_micros("sequence") for i, r in enumerate(rules) if r.has_sequence}
    span = literal_by_rule([spans.get(i, 1) for i in range(len(rules))], "bigint")
    return cooldown(qualifying, ["rule_ix", "key"], "t", span, set(spans.values()))


def sequence_members(rows: DataFrame, fired: DataFrame, rules) -> DataFrame:
    """Evidence of each firing: the hit itself and its two earliest priors.

    Windows of firings of one key never overlap (they are more than w apart), so a prior meets at
    most one firing; the time slice in the join key keeps busy keys spread out.
    """
    spans = {i: r.span_micros("sequence") for i, r in enumerate(rules) if r.has_sequence}
    span = literal_by_rule([spans.get(i, 1) for i in range(len(rules))], "bigint")
    at = ["rule_ix", "key", "t"]
    trigger = first_k(rows.filter(~F.col("is_prior")), at, ["event_seq"], 1).drop("rank")
    trigger = trigger.join(fired.select(*at, "prior_events"), at).withColumn("fire_t", F.col("t"))
    priors = first_k(rows.filter("is_prior"), at, ["event_seq"], 2).drop("rank")
    priors = priors.withColumn("cell", floor_div(F.col("t"), span))
    cells = F.array_distinct(F.array(floor_div(F.col("t"), span), floor_div(F.col("t") - span, span)))
    reach = fired.select("rule_ix", "key", F.col("t").alias("fire_t"), "prior_events",
                         (F.col("t") - span).alias("from_t"), F.explode(cells).alias("cell"))
    earlier = (priors.join(reach, ["rule_ix", "key", "cell"])
               .filter((F.col("t") >= F.col("from_t")) & (F.col("t") <= F.col("fire_t"))))
    earlier = first_k(earlier, ["rule_ix", "key", "fire_t"], ["t", "event_seq"], 2)
    return (trigger.withColumn("place", F.lit(0))
            .unionByName(earlier.withColumnRenamed("rank", "place").drop("cell", "from_t")))
