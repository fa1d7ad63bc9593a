"""Sliding sums against a plain loop, and at a size where work by the square would not end."""
import random
import time

from pyspark.sql import functions as F

from secframe.operators.beacon import densest_windows
from secframe.operators.sequence import cooldown
from secframe.operators.skew import sliding_sum


def test_sliding_sums_equal_a_loop(spark):
    rnd = random.Random(8)
    rows = sorted({(rnd.choice(["a", "b", None]), rnd.randrange(-400, 400)) for _ in range(300)}, key=str)
    rows = [(k, t, rnd.randrange(3)) for k, t in rows]
    df = spark.createDataFrame(rows, "k string, t bigint, n bigint").withColumn("w", F.when(F.col("k") == "a", 7).otherwise(40).cast("bigint"))
    got = sorted(((r.k, r.t, r.s) for r in sliding_sum(df, ["k"], "t", "n", F.when(F.col("k") == "a", 7).otherwise(40).cast("bigint"), "s").collect()), key=str)
    width = {"a": 7, "b": 40, None: 40}
    assert got == sorted(((k, t, sum(m for j, u, m in rows if j == k and t - width[k] <= u <= t)) for k, t, _ in rows), key=str)


def test_a_busy_key_costs_no_more_than_its_events(spark):
    n = 300_000
    hot = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.lit(1).cast("bigint").alias("n"))
    start = time.time()
    (row,) = densest_windows(hot, ["k"], F.lit(n // 2).cast("bigint")).collect()
    assert (row.window_end, row.in_window) == (n // 2, n // 2 + 1)
    points = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    fired = sorted(r.t for r in cooldown(points, ["k"], "t", F.lit(n // 3).cast("bigint"), {n // 3}).collect())
    assert fired == [0, n // 3 + 1, 2 * (n // 3 + 1)]
    assert time.time() - start < 90         # some 10^10 steps in frames that are summed row by row


def test_a_stream_is_dealt_to_places_not_to_keys(spark):
    """However many keys arrive, a step is called a bounded number of times; counts of keys side by side stay apart."""
    import numpy as np
    from secframe.streaming.sequences import PLACES, place_of, sliding_counts
    many = spark.range(20_000).select(place_of(F.col("id").cast("string")).alias("p")).groupBy("p").count()
    assert many.count() == PLACES and many.agg(F.max("count")).first()[0] < 3 * 20_000 / PLACES
    rnd = random.Random(9)
    rows = [(rnd.randrange(4), rnd.randrange(60), rnd.randrange(3)) for _ in range(200)]
    who, t, n = (np.array(c, np.int64) for c in zip(*rows))
    assert sliding_counts(who, t, n, 7).tolist() == [sum(m for j, u, m in rows if j == k and at - 7 <= u <= at) for k, at, _ in rows]
