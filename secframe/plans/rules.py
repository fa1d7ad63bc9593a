"""Detection rules as data."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from secframe.functions.match import Fields, as_list, compile_condition

DEFAULT_MINUTES = 60.0


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str = "medium"
    confidence: str = "medium"
    risk: int = 40
    tactic: str = "unknown"
    category: str = "general"
    technique: tuple = ()
    datasets: tuple = ()
    condition: tuple = ()
    filter: tuple = ()
    threshold: dict = field(default_factory=dict)
    requires: dict = field(default_factory=dict)
    window: dict = field(default_factory=dict)
    config: dict = field(default_factory=dict)
    enabled: bool = True

    @classmethod
    def of(cls, doc: dict) -> "Rule":
        rid = doc.get("id") or doc.get("title") or "UNNAMED"
        return cls(
            id=rid, name=doc.get("name") or rid,
            severity=doc.get("severity", "medium"), confidence=doc.get("confidence", "medium"),
            risk=int(doc.get("risk", 40)), tactic=doc.get("tactic", "unknown"),
            category=doc.get("category", "general"), technique=tuple(as_list(doc.get("technique"))),
            datasets=tuple(sorted(set(as_list((doc.get("logsource") or {}).get("dataset"))))),
            condition=tuple(as_list(doc.get("condition"))), filter=tuple(as_list(doc.get("filter"))),
            threshold=doc.get("threshold") or {}, requires=doc.get("requires") or {},
            window=doc.get("window") or {}, config=doc.get("config") or {},
            enabled=doc.get("enabled", True))

    # ---- which analytics the rule asks for
    @property
    def mode(self) -> str:
        if self.config.get("time_stats"):
            return "beacon"
        if self.window:
            return "travel"
        if self.threshold:
            return "threshold"
        return "sequence" if self.requires else "single"

    @property
    def has_sequence(self) -> bool:
        """A threshold rule with ``requires`` falls back to the sequence when it stays quiet."""
        return self.mode == "sequence" or (self.mode == "threshold" and bool(self.requires))

    def span_micros(self, part: str) -> int:
        doc = {"threshold": self.threshold, "sequence": self.requires,
               "beacon": self.config.get("threshold", {})}.get(part)
        if part == "travel":
            minutes = self.window.get("span_minutes", DEFAULT_MINUTES)
        else:
            minutes = doc.get("window_minutes", 30 if part == "beacon" else DEFAULT_MINUTES)
        return max(1, int(round(float(minutes) * 60_000_000)))

    def key_fields(self, part: str) -> tuple:
        if part == "threshold":
            return tuple(as_list(self.threshold.get("field")))
        if part == "sequence":
            return tuple(as_list(self.requires.get("key_fields") or self.threshold.get("field")))
        if part == "travel":
            return tuple(as_list(self.window.get("group_by")))
        if part == "beacon":
            return tuple(as_list(self.config.get("group_by")))
        return ()

    # ---- predicates
    def hit(self, fields: Fields) -> Column:
        """In scope, matching the condition and not filtered out."""
        pred = compile_condition(self.condition, fields)
        if self.datasets:
            pred = fields.resolve("event.dataset")[0].isin(list(self.datasets)) & pred
        if self.filter:
            pred = pred & ~F.coalesce(compile_condition(self.filter, fields), F.lit(False))
        excluded = [str(p).lower() for p in as_list(self.config.get("exclude_processes"))]
        if self.mode == "beacon" and excluded:
            process = fields.resolve("process.name")[0]
            pred = pred & ~F.coalesce(F.lower(process), F.lit("")).isin(excluded)
        return pred

    def prior(self, fields: Fields) -> Column:
        """Prior events come from every dataset and ignore the filter."""
        return compile_condition(self.requires.get("condition"), fields)


def load_rules(docs) -> list[Rule]:
    """Rule documents -> enabled rules; a repeated id is an error that names it."""
    rules = [d if isinstance(d, Rule) else Rule.of(d) for d in docs]
    seen, repeated = set(), []
    for r in rules:
        if r.id in seen:
            repeated.append(r.id)
        seen.add(r.id)
    if repeated:
        raise ValueError(f"rule ids must be unique, repeated: {sorted(set(repeated))}")
    return [r for r in rules if r.enabled]


def load_rule_files(paths) -> list[Rule]:
    """Rules from JSON or YAML documents (YAML only where a parser is installed)."""
    import json

    docs = []
    for path in paths:
        with open(path, encoding="utf-8") as fh:
            if str(path).endswith(".json"):
                loaded = json.load(fh)
            else:
                import yaml
                loaded = yaml.safe_load(fh) or []
        docs.extend(as_list(loaded))
    return load_rules(docs)


def rules_frame(spark: SparkSession, rules) -> DataFrame:
    """Catalogue table: one row per rule (size bounded by the rule count)."""
    rows = [(i, r.id, r.name, r.severity, r.confidence, r.risk, r.tactic, r.category,
             list(r.technique), list(r.datasets), r.mode, bool(r.filter), bool(r.threshold),
             bool(r.requires), bool(r.window), bool(r.config.get("time_stats")))
            for i, r in enumerate(rules)]
    return spark.createDataFrame(
        rows, "rule_ix int, rule_id string, rule_name string, severity string, confidence string, "
              "risk int, tactic string, category string, technique array<string>, "
              "datasets array<string>, mode string, has_filter boolean, has_threshold boolean, "
              "has_requires boolean, has_window boolean, has_baseline boolean")


def catalogue_by_tactic(rules_df: DataFrame) -> DataFrame:
    return (rules_df.select("tactic", "rule_id", F.explode_outer("technique").alias("technique"))
            .groupBy("tactic")
            .agg(F.count_distinct("rule_id").alias("rules"),
                 F.count_distinct("technique").alias("techniques"),
                 F.array_sort(F.collect_set("rule_id")).alias("rule_ids")))


def repeated_rule_ids(rules_df: DataFrame) -> DataFrame:
    return rules_df.groupBy("rule_id").count().filter("count > 1")
