"""Multi-rule evaluation in one scan of the events."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from secframe.functions.match import Fields
from secframe.functions.values import any_of, micros
from secframe.schema import LOWERCASED, column_name

# fields an alert reports as entities, in reporting order
ENTITY_FIELDS = ["user_name", "host_name", "source_ip", "destination_ip", "destination_domain",
                 "process_name", "url_path", "dns_question_name", "file_path", "network_bytes",
                 "process_command_line"]
DISTINCT_FIELDS = ["user_name", "destination_port", "destination_domain", "dns_question_name"]
EVIDENCE = ENTITY_FIELDS + ["destination_port", "bytes_sent", "event_action"]
_BITS = 62


def literal_by_rule(values, dtype: str, index: str = "rule_ix") -> Column:
    """Per-rule constant picked by rule index."""
    return F.array(*[F.lit(v).cast(dtype) for v in values])[F.col(index)]


def group_key(df: DataFrame, fields) -> Column:
    """Null-safe composite key: missing or empty parts become '?'; no fields is one group."""
    resolver = Fields(df)
    parts = []
    for f in fields:
        text = resolver.resolve(f)[0].cast("string")
        parts.append(F.coalesce(F.when(text != "", text), F.lit("?")))
    return F.concat_ws("|", *parts) if parts else F.lit("__all__")


def key_by_rule(df: DataFrame, rules, part: str) -> Column:
    """Key of each row under its own rule; rules sharing key fields share the expression."""
    by_fields = {}
    for i, r in enumerate(rules):
        by_fields.setdefault(r.key_fields(part), []).append(i)
    out = None
    for fields, ixs in by_fields.items():
        test = F.col("rule_ix").isin(ixs)
        out = F.when(test, group_key(df, fields)) if out is None else out.when(
            test, group_key(df, fields))
    return out


def rule_hits(events: DataFrame, rules, lowercased=LOWERCASED, keep=None) -> DataFrame:
    """One row per (event, rule) match: ``rule_ix``, ``is_prior``, ``t`` and the event columns.

    All predicates are evaluated while the event is in hand and packed into bit masks; events
    matching nothing are dropped before anything is exploded, so the cost is one scan however
    many rules there are.  Prior-event conditions of sequence rules ride along as extra bits.
    """
    resolver = Fields(events, lowercased)
    probes = [(i, False, r.hit(resolver)) for i, r in enumerate(rules)]
    probes += [(i, True, r.prior(resolver)) for i, r in enumerate(rules) if r.has_sequence]
    base = events.withColumn("t", micros(F.col("ts"))).filter(F.col("t").isNotNull())
    keep = [c for c in (keep or events.columns) if c in events.columns]
    out = [F.col(c) for c in keep]

    if len(probes) == 1:        # a lone predicate stays a plain filter and can be pushed down
        ix, prior, pred = probes[0]
        return base.filter(pred).select(F.lit(ix).alias("rule_ix"),
                                        F.lit(prior).alias("is_prior"), "t", *out)

    scopes = [set(r.datasets) for r in rules]
    if all(scopes) and not any(r.has_sequence for r in rules) and "event_dataset" in events.columns:
        base = base.filter(F.col("event_dataset").isin(sorted(set().union(*scopes))))
    masks = []
    for start in range(0, len(probes), _BITS):
        bits = [F.when(p, F.lit(1 << n).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
                for n, (_, _, p) in enumerate(probes[start:start + _BITS])]
        masks.append(reduce(lambda a, b: a + b, bits))
    names = [f"_mask{i}" for i in range(len(masks))]
    marked = base.select(*out, "t", *[m.alias(n) for m, n in zip(masks, names)])
    marked = marked.filter(any_of(F.col(n) != 0 for n in names))
    found = F.array_compact(F.array(*[
        F.when(F.getbit(F.col(names[i // _BITS]), F.lit(i % _BITS)) == 1, F.lit(i))
        for i in range(len(probes))]))
    exploded = marked.select(*keep, "t", F.explode(found).alias("_probe"))
    return exploded.select(
        literal_by_rule([p[0] for p in probes], "int", "_probe").alias("rule_ix"),
        literal_by_rule([p[1] for p in probes], "boolean", "_probe").alias("is_prior"),
        "t", *keep)


def with_evidence(hits: DataFrame) -> DataFrame:
    """Make sure every evidence column exists (null where the table has no such field)."""
    present = set(hits.columns)
    return hits.select("*", *[F.lit(None).cast("string").alias(c)
                              for c in EVIDENCE if c not in present])
