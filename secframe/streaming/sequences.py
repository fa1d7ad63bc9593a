"""Prior-event sequences with cooldown on streams, with the results of the batch operator.

Three stateful steps, each in append mode.  Counting per (rule, key, instant) combines on the map
side and holds every instant until the watermark has passed it, so what follows sees each instant
once, complete, and in time order from batch to batch.  The sliding count of priors runs per (rule,
place, time slice), where a place holds many keys, dealt by hash: a batch costs a call per place, not
one per key, and a busy key that catches up on a long backlog is spread over its slices.  The cooldown
runs per (rule, place) on the qualifying instants only; its state is a number per key that fired lately.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from secframe.functions.values import micros
from secframe.operators.hits import key_by_rule, rule_hits
from secframe.operators.skew import time_slices
from secframe.plans.rules import load_rules
from secframe.schema import LOWERCASED

#: State with several kinds of variables and timers needs this provider.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
QUALIFIED = "rule_ix int, key string, ts timestamp, t bigint, prior_events bigint"
#: Keys are dealt to this many places.
PLACES = 256
FIRED = "rule_ix int, key string, t bigint, prior_events bigint"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set(*STATE_STORE)


def timed(events: DataFrame, delay: str) -> DataFrame:
    """Events under a watermark that every event moves, whether or not a rule wants it.

    Spark moves filters below the watermark unless they depend on its column; then only matching
    events would move it.  So every column is made to depend on ``ts`` (null times are dropped
    later in any case).
    """
    e = events.withWatermark("ts", delay)
    return e.select("ts", *[F.when(F.col("ts").isNotNull(), F.col(f"`{c}`")).alias(c) for c in e.columns if c != "ts"])


def place_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PLACES)).cast("int")


def sliding_counts(who: np.ndarray, t: np.ndarray, n: np.ndarray, span: int) -> np.ndarray:
    """Sum of ``n`` over the rows of the same ``who`` in [t - span, t], for every row."""
    who, at, by = np.concatenate([who, who]), np.concatenate([t, t + span + 1]), np.concatenate([n, -n])
    order = np.lexsort((at, who))
    who, at = who[order], at[order]
    last = np.append((who[1:] != who[:-1]) | (at[1:] != at[:-1]), True)     # of one key and instant
    running = np.cumsum(by[order])[last]        # everything that enters leaves, so each key starts at zero
    out = np.empty(len(order), np.int64)
    out[order] = running[np.cumsum(last) - last]
    return out[:len(t)]


class Later(StatefulProcessor):
    """State for as long as a later instant can reach it; instants of later batches are later for every key."""

    def keep_until(self, t: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(t) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing after the timer can reach back to what is held."""
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class Preceded(Later):
    """Own instants of a place and slice with enough priors of their key in the rule's window before them."""

    def __init__(self, spans: dict, least: dict):
        self.spans, self.least = spans, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("priors", "key string, t bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rule_ix, span = key[0], self.spans[key[0]]
        new = pd.concat(list(rows), ignore_index=True)
        held = [tuple(p) for p in self.held.get()]
        names = np.array([p[0] for p in held] + new["key"].tolist(), object)
        t = np.concatenate([np.array([p[1] for p in held], np.int64), new["t"].to_numpy(np.int64)])
        n = np.concatenate([np.array([p[2] for p in held], np.int64), new["priors"].to_numpy(np.int64)])
        found = sliding_counts(pd.factorize(names)[0], t, n, span)[len(held):]
        enough = new["own"].to_numpy(bool) & (new["hits"].to_numpy() > 0) & (found >= self.least[rule_ix])
        keep = (t >= t.max() - span) & (n > 0)
        self.held.clear()
        if keep.any():
            self.held.put(list(zip(names[keep].tolist(), t[keep].tolist(), n[keep].tolist())))
            self.keep_until(t.max() + span)
        asked = new[enough]
        yield pd.DataFrame({"rule_ix": rule_ix, "key": asked["key"].to_numpy(), "ts": asked["ts"].to_numpy(), "t": asked["t"].to_numpy(np.int64),
                            "prior_events": found[enough]})


class Cooldown(Later):
    """After a firing, qualifying instants of its key up to and including the end of the rule's window are skipped."""

    def __init__(self, spans: dict):
        self.spans = spans

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("fired", "key string, t bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rule_ix, span, out = key[0], self.spans[key[0]], []
        last = {name: t for name, t in self.held.get()}
        points = pd.concat(list(rows)).sort_values("t")
        for name, t, n in zip(points["key"].tolist(), points["t"].tolist(), points["prior_events"].tolist()):
            if name not in last or t - last[name] > span:
                last[name] = t
                out.append((rule_ix, name, t, n))
        now = int(points["t"].max())
        self.held.clear()
        recent = [(name, t) for name, t in last.items() if t >= now - span]
        if recent:
            self.held.put(recent)
            self.keep_until(max(t for _, t in recent) + span)
        yield pd.DataFrame(out, columns=["rule_ix", "key", "t", "prior_events"])


def stream_sequences(events: DataFrame, rules, lowercased=LOWERCASED, delay: str = "1 hour") -> DataFrame:
    """Sequence firings with cooldown: (rule_ix, key, t, prior_events), for append mode.

    A hit is judged once the watermark has passed it, so priors that arrive after it, up to
    ``delay`` late, still count, and the result is that of the batch operator for all events that
    were not later than that.  Call ``use_state_store`` on the session before the query starts.
    """
    rules = load_rules(rules)
    spans = {i: r.span_micros("sequence") for i, r in enumerate(rules) if r.has_sequence}
    least = {i: int(r.requires.get("min_count", 1)) for i, r in enumerate(rules) if r.has_sequence}
    hits = rule_hits(timed(events, delay), rules, lowercased)
    keyed = hits.filter(F.col("rule_ix").isin(list(spans))).select(
        "rule_ix", F.coalesce(key_by_rule(hits, rules, "sequence"), F.lit("?")).alias("key"), "ts", "is_prior")
    instants = keyed.groupBy("rule_ix", "key", "ts").agg(
        F.count_if(F.col("is_prior")).alias("priors"), F.count_if(~F.col("is_prior")).alias("hits"))
    sliced = time_slices(instants.withColumn("t", micros(F.col("ts"))), "t", back=max(spans.values()))
    qualified = sliced.withColumn("place", place_of(F.col("key"))).groupBy("rule_ix", "place", "slice").transformWithStateInPandas(
        Preceded(spans, least), QUALIFIED, "append", "eventTime", eventTimeColumnName="ts")
    return qualified.withColumn("place", place_of(F.col("key"))).groupBy("rule_ix", "place").transformWithStateInPandas(Cooldown(spans), FIRED, "append", "eventTime")
