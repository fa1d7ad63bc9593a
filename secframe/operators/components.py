"""Connected components by contraction, with a shared-folder cut per round."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from secframe.session import materialize


def _rank(c: str):
    """Random but repeatable order of nodes: ever smaller neighbours form short chains only."""
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))


def connected_components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(a, b) edges and (node) list -> (node, component), component = smallest node id in it.

    Every round each node points at its smallest neighbour (a plain min aggregate, combined on
    the map side), pointers are squared once, and edges are rewritten onto the pointed-at nodes;
    duplicates and loops drop out.  Rewriting both ends of every edge keeps connected what was
    connected, so pointers need not reach their roots within a round.  The edge list shrinks by a
    constant factor per round and no group of neighbours is ever collected.

    Only the shrinking edge list and the pointers are written out per round; the owner of each
    node is the composition of the pointer tables, evaluated once at the end.
    """
    live = materialize(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    owner = nodes.select("node").distinct().withColumn("root", F.col("node"))
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(_rank("b")).alias("low"))
        near = low.select(F.col("a").alias("node"),
                          F.least(F.col("low"), _rank("a"))["node"].alias("to"))
        ahead = near.select(F.col("node").alias("to"), F.col("to").alias("far"))
        points = materialize(near.join(ahead, "to").select("node", F.col("far").alias("to")),
                             "pointers")
        roots = lambda side: points.select(F.col("node").alias(side), F.col("to").alias(f"{side}_r"))
        live = materialize(live.join(roots("a"), "a").join(roots("b"), "b")
                           .select(F.col("a_r").alias("a"), F.col("b_r").alias("b"))
                           .filter(F.col("a") != F.col("b")).distinct(), "edges")
        owner = (owner.join(points.select(F.col("node").alias("root"), "to"), "root", "left")
                 .select("node", F.coalesce("to", "root").alias("root")))
    else:
        raise RuntimeError("components did not converge")
    names = owner.groupBy("root").agg(F.min("node").alias("component"))
    return owner.join(names, "root").select("node", "component")
