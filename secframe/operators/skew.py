"""Building blocks that keep hot keys from landing in one task.

A window partitioned by an entity key alone would put a third of the data in one task when one
entity is that busy.  These helpers cut such groups along the order axis instead.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from secframe.functions.values import floor_div

# slices span several look-back lengths, so only the rows near a slice edge are copied
SLICE_FACTOR = 8


def time_slices(df: DataFrame, t: str, back: int, forward: int = 0) -> DataFrame:
    """Cut the time axis into slices and copy edge rows into the neighbouring slice.

    ``t`` is a bigint column.  Each row is ``own`` in exactly one ``slice``; rows that another
    slice may need within ``back`` before or ``forward`` after its own rows are added there with
    ``own = false``.  Windows may then partition by (key, slice) and see all they need, and a
    group never holds more than a fixed stretch of time.
    """
    width = SLICE_FACTOR * max(back, forward, 1)
    s = floor_div(F.col(t), width)
    into = F.col(t) - s * width
    homes = F.array_compact(F.array(
        F.struct(s.alias("slice"), F.lit(True).alias("own")),
        F.when(into >= width - back, F.struct((s + 1).alias("slice"), F.lit(False).alias("own"))),
        F.when(into < forward, F.struct((s - 1).alias("slice"), F.lit(False).alias("own")))))
    return df.select("*", F.explode(homes).alias("_home")).select(
        *df.columns, F.col("_home.slice").alias("slice"), F.col("_home.own").alias("own"))


def sliding_sum(df: DataFrame, keys, t: str, value: str, span: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of the same key in [t - span, t], at a cost that does not depend on how many those are.

    ``df`` has one row per (keys, t) and ``span`` depends on ``keys`` only.  A value enters at t and
    leaves after t + span, so the sum is a running one over both.  It runs inside cells, a fraction of
    a span long, from what the cells before leave (one row per cell): a busy key is spread over its cells.
    """
    held, leaves = F.col(value), F.col(t) + span + 1
    moves = df.select("*", F.explode(F.array_compact(F.array(
        F.struct(F.col(t).alias("at"), held.alias("by"), F.lit(True).alias("own")),
        F.when(held != 0, F.struct(leaves.alias("at"), (-held).alias("by"), F.lit(False).alias("own")))))).alias("_move"))
    width = F.greatest(F.lit(1).cast("bigint"), floor_div(span, SLICE_FACTOR))
    moves = moves.select(*df.columns, F.col("_move.at").alias("_at"), F.col("_move.by").alias("_by"), F.col("_move.own").alias("_own"),
                         floor_div(F.col("_move.at"), width).alias("_cell"))
    before = running_offset(moves, keys, [("_cell", False)], F.sum("_by"))
    before = before.select(*keys, "_cell", F.col("offset").alias("_by"), F.lit(False).alias("_own"))
    w = Window.partitionBy(*keys, "_cell").orderBy("_at")       # what came before has no time, so it is first
    rows = moves.unionByName(before, allowMissingColumns=True)
    return rows.withColumn(name, F.sum("_by").over(w)).filter("_own").select(*df.columns, name)


def first_k(df: DataFrame, keys, order, k: int, name: str = "rank") -> DataFrame:
    """First k rows per group, numbered from 1.

    Spark turns the rank filter into a group limit on both sides of the shuffle, so a task sends
    at most k rows of a group however large the group is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def running_offset(df: DataFrame, keys, bin_order, size: Column) -> DataFrame:
    """Rows per bin before each bin: (keys, bins) -> ``offset``, ``n``.

    The rows are first reduced to one per bin, so the window only sees bin counts.
    """
    names = [n for n, _ in bin_order]
    counts = df.groupBy(*keys, *names).agg(size.alias("n"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(
        *[F.col(n).desc() if desc else F.col(n) for n, desc in bin_order]
    ).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("bigint"))


def global_rank(df: DataFrame, bin_order, order, name: str) -> DataFrame:
    """Row numbers over the whole table without gathering it in one task.

    Bins (a coarse prefix of the sort order) get their starting offset from counts; rows are
    numbered inside their bin only.
    """
    bins = [n for n, _ in bin_order]
    offsets = running_offset(df, [], bin_order, F.count(F.lit(1))).drop("n")
    inner = Window.partitionBy(*bins).orderBy(*order)
    return (df.withColumn("_in_bin", F.row_number().over(inner)).join(offsets, bins)
            .withColumn(name, F.col("offset") + F.col("_in_bin")).drop("_in_bin", "offset"))


def previous_in_order(df: DataFrame, keys, bin_order, order, payload: Column, name: str) -> DataFrame:
    """Payload of the preceding row of the same key, for groups too large for one window.

    Rows look back inside their (key, bin); the first row of a bin takes the last row of the
    nearest earlier non-empty bin, found among one row per bin.
    """
    bins = [n for n, _ in bin_order]
    rows = df.withColumn("_payload", payload)
    inner = Window.partitionBy(*keys, *bins).orderBy(*order)
    rows = rows.withColumn("_lag", F.lag("_payload").over(inner)) \
               .withColumn("_pos", F.row_number().over(inner)) \
               .withColumn("_last", F.lead(F.lit(1)).over(inner).isNull())
    ends = rows.filter("_last").select(*keys, *bins, "_payload")
    across = Window.partitionBy(*keys).orderBy(
        *[F.col(n).desc() if desc else F.col(n) for n, desc in bin_order])
    ends = ends.select(*keys, *bins, F.lag("_payload").over(across).alias("_before"))
    first = rows.filter("_pos = 1").join(ends, [*keys, *bins]).withColumn("_lag", F.col("_before"))
    rest = rows.filter("_pos > 1")
    return (first.drop("_before").unionByName(rest)
            .withColumnRenamed("_lag", name).drop("_payload", "_pos", "_last"))


def exact_median(df: DataFrame, value: str, bin_width: int, keys=()) -> DataFrame:
    """Exact median of a bigint column per key group, without holding the values in one buffer.

    Equal values are counted first; bins locate the middle rank, then only counts inside bins are
    accumulated.
    """
    keys = list(keys)
    counted = (df.filter(F.col(value).isNotNull())
               .withColumn("_bin", floor_div(F.col(value), bin_width))
               .groupBy(*keys, "_bin", value).agg(F.count(F.lit(1)).alias("_c")))
    bins = running_offset(counted, keys, [("_bin", False)], F.sum("_c").cast("bigint"))
    total = counted.groupBy(*keys).agg(F.sum("_c").alias("_total"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(value)
    ranked = counted.join(bins, [*keys, "_bin"]).withColumn(
        "_hi", F.col("offset") + F.sum("_c").over(inside))
    ranked = ranked.join(total, keys) if keys else ranked.withColumn("_total", total.scalar())
    lo, hi = F.col("_hi") - F.col("_c"), F.col("_hi")
    mid_a = F.call_function("div", F.col("_total") - 1, F.lit(2))
    mid_b = F.call_function("div", F.col("_total"), F.lit(2))
    covers = lambda r: (lo <= r) & (r < hi)
    return (ranked.filter(covers(mid_a) | covers(mid_b)).groupBy(*keys)
            .agg(((F.min(value) + F.max(value)) / 2.0).alias("median")))
