"""Groups of alike sets from bands: stars first, then every pair that a star left open.

The members of a band meet two of them; a pair of other members is open as long as the two are in
different components.  Further stars run inside the open bands while they close most of them, and
what is left is joined exactly: by the rarest members of each set (prefix and position filter), or
inside the bands by a condition that all alike pairs meet.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from secframe.llm.common import Scratch
from secframe.operators.components import connected_components

#: Rows of one rare member or band that meet in one cell of an exact join; longer lists are cut into blocks, all of which meet.
BLOCK = 2000


def _ordered(df: DataFrame) -> DataFrame:
    return df.select(F.least("id", "peer").alias("a"), F.greatest("id", "peer").alias("b")).distinct()


def first_stars(banded: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b) pairs of every member of a band with its smallest and largest id, and the (key, id) of
    the members between, of bands where two of them never met.

    Both read the members of bands with several members, which are written once where a scratch folder is given.
    """
    full = banded.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
    if scratch is not None:
        shared = scratch.keep(banded.join(full.hint("shuffle_hash"), "key"), "shared")
        met = shared.select("id", F.explode(F.array("lo", "hi")).alias("peer")).filter("id <> peer")
        return scratch.keep(_ordered(met), "pairs"), shared.filter("n > 3 AND id <> lo AND id <> hi").select("key", "id")
    met = banded.join(full.select("key", "lo", "hi"), "key").select("id", F.explode(F.array("lo", "hi")).alias("peer")).filter("id <> peer")
    between = banded.join(full.filter("n > 3"), "key").filter("id <> lo AND id <> hi").select("key", "id")
    return _ordered(met), between


def _merge(owner: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``owner`` (node, component) after further links (a, b); nodes outside it are their own component."""
    of = lambda side: owner.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")).distinct()
    edges = scratch.keep(edges, f"{name}_edges")
    moved = connected_components(edges, edges.select(F.explode(F.array("a", "b")).alias("node")))
    moved = moved.select(F.col("node").alias("old"), F.col("component").alias("new"))
    nodes = owner.unionByName(edges.select(F.explode(F.array("a", "b")).alias("node")).withColumn("component", F.col("node")))
    return scratch.keep(nodes.join(moved, F.col("component") == F.col("old"), "left")
                        .select("node", F.coalesce("new", "component").alias("component")).distinct(), name)


def _open(between: DataFrame, owner: DataFrame) -> DataFrame:
    """(key, id, c) of the bands whose members are in several components."""
    named = between.select("key", "id").join(owner, F.col("id") == F.col("node"), "left").select(
        "key", "id", F.coalesce("component", "id").alias("c"))
    several = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    return named.join(several, "key").select("key", "id", "c")


def _ordered_sets(sets: DataFrame) -> DataFrame:
    """(id, c, ms): members with their counts, rarest first."""
    flat = sets.select("id", "c", F.xxhash64("members").alias("sid"), F.explode("members").alias("m"))
    count = flat.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    order = F.sort_array(F.collect_list(F.struct("n", "m")))
    return flat.join(count, "m").groupBy("id", "c", "sid").agg(order.alias("ms")).select("id", "c", "ms")


def _cells(rows: DataFrame, key: str, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows of every key with several rows as two sides (columns a_.., b_..) that meet in (key, row, col)."""
    lists = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n_rows"))
    at = rows.join(lists.filter("n_rows > 1").drop("n_rows"), key).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = lambda s, row, col: at.select(key, F.col(row).alias("row"), F.col(col).alias("col"), *[
        F.col(x).alias(f"{s}_{x}") for x in rows.columns if x != key])
    return side("a", "own", "other"), side("b", "other", "own")


def exact_pairs(sets: DataFrame, like: int, block: int = BLOCK) -> DataFrame:
    """(a, b) of (id, c, members) with different c that can be alike: no pair of that similarity is lost.

    Members are ordered rarest first.  Alike sets share one of their first members, so early in both
    that enough members can follow.
    """
    size = F.size("ms")
    head = _ordered_sets(sets).select("id", "c", size.alias("size"), F.posexplode(
        F.slice("ms", F.lit(1), size - F.floor((size * like + 99) / 100).cast("int") + 1)).alias("at", "x"))
    head = head.filter("x.n > 1").select("id", "c", "size", "at", F.col("x.m").alias("m"))
    a, b = _cells(head, "m", block)
    both = a.join(b, ["m", "row", "col"])
    ahead = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    both = both.filter((F.col("a_id") < F.col("b_id")) & (F.col("a_c") != F.col("b_c"))
                       & (ahead * (100 + like) >= (F.col("a_size") + F.col("b_size")) * like))
    return both.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def band_pairs(rows: DataFrame, may: Column, block: int = BLOCK) -> DataFrame:
    """(a, b) of rows (key, id, c, ...) with one key and different c that meet ``may``, a condition on columns a_.. and b_..

    The condition is part of the join, so only pairs that meet it leave it.
    """
    a, b = _cells(rows, "key", block)
    both = a.join(b, ["key", "row", "col"]).filter((F.col("a_id") < F.col("b_id")) & (F.col("a_c") != F.col("b_c")) & may)
    return both.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def shares(a: Column, b: Column, like: int) -> Column:
    """Whether two arrays of distinct members have this Jaccard similarity, in hundredths."""
    shared = F.size(F.array_intersect(a, b))
    return 100 * shared >= like * (F.size(a) + F.size(b) - shared)


def groups(between: DataFrame, links: DataFrame, alike: Callable[[DataFrame], DataFrame],
           links_within: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """(node, component) over ``links`` (a, b) and all alike pairs among members of one band in ``between``.

    ``alike`` keeps the alike ones of pairs (a, b); ``links_within`` gives all alike pairs (a, b) of
    different c among the open members (key, id, c) of a band.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("node"))
    owner = scratch.keep(connected_components(links, ends), "owner0")
    step, n = 0, None
    while True:
        left = scratch.keep(_open(between, owner), f"open{step}")
        before, n = n, left.count()
        if not n:
            return owner
        step += 1
        if before is not None and 2 * n > before:
            return _merge(owner, scratch.keep(links_within(left), "exact_links"), scratch, f"owner{step}")
        who = F.struct("c", "id")
        ends = left.groupBy("key").agg(F.min(who).alias("lo"), F.max(who).alias("hi"))
        at = left.join(ends, "key")
        met = at.select("id", "c", F.explode(F.array("lo", "hi")).alias("p")).filter("c <> p.c").select("id", F.col("p.id").alias("peer"))
        pairs = scratch.keep(_ordered(met), f"star{step}")
        between = at.filter("id <> lo.id AND id <> hi.id").select("key", "id")
        owner = _merge(owner, scratch.keep(alike(pairs), f"star_links{step}"), scratch, f"owner{step}")
