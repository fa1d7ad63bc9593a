"""Alert enrichment and scoring: lookup joins on exploded entities, then column arithmetic."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from secframe.functions.net import is_internal
from secframe.functions.values import any_of
from secframe.operators.alerts import listed_values
from secframe.operators.geo import locate
from secframe.operators.skew import first_k
from secframe.plans import settings as cfg
from secframe.session import materialize

#: What a row shows: asset hosts, intel hits, and hits named in the reason.
ASSET_HOSTS, INTEL_HITS, REASON_HITS = 6, 12, 4


def entity(name: str) -> Column:
    return F.col("entities").getItem(name)


def _exploded(alerts: DataFrame, *kinds: str, values: DataFrame | None = None) -> DataFrame:
    """(alert_id, kind, pos, value) of some kinds: from the long table of all values, or from the alerts' lists."""
    values = listed_values(alerts) if values is None else values
    return values.filter(F.col("kind").isin(*kinds))


def match_ips(values: DataFrame, intel_ip: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Exact feed hits; addresses in anonymizer networks count as hits of a fixed confidence.

    Every address is judged once, however many alerts name it.
    """
    ips = values.filter(F.col("kind").isin("source_ip", "destination_ip"))
    feed = intel_ip.select(F.col("ip").alias("value"), F.col("category").alias("f_category"),
                           F.col("confidence").alias("f_confidence"), *([F.col("feed").alias("f_feed")] if "feed" in intel_ip.columns
                                                                        else [F.lit(None).cast("string").alias("f_feed")]))
    places = locate(ips.select(F.trim("value").alias("ip")), prefixes).select(
        F.col("ip").alias("value"), F.col("category").alias("g_category"))
    anonymous = F.col("g_category") == "anonymizer"
    known = (places.join(feed, "value", "left")
             .withColumn("category", F.coalesce("f_category", F.when(anonymous, "anonymizer")))
             .withColumn("confidence", F.coalesce("f_confidence", F.when(
                 anonymous, F.lit(cfg.ANONYMIZER_CONFIDENCE))))
             .withColumn("feed", F.when(F.col("f_category").isNotNull(), F.col("f_feed")).when(anonymous, cfg.ANONYMIZER_SOURCE))
             .filter(F.col("category").isNotNull()).select("value", "category", "confidence", "feed"))
    return (ips.withColumn("value", F.trim("value")).join(known, "value")
            .select("alert_id", "kind", "pos", "value", "category", "confidence", "feed"))


def domain_suffixes(domain: Column) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]: suffixes that start at a label."""
    labels = F.split(F.lower(domain), r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(
        F.slice(labels, i, n - i + 1), "."))


def match_domains(values: DataFrame, intel_domain: DataFrame) -> DataFrame:
    """Feed suffix of each domain, at label boundaries; the first in feed order wins."""
    names = values.filter(F.col("kind").isin("destination_domain", "dns_question_name"))
    tried = names.select("value").distinct().select("value", F.explode(domain_suffixes(F.col("value"))).alias("suffix"))
    feed = intel_domain.withColumn("suffix", F.lower("suffix"))
    hit = F.min(F.struct("feed_rank", "suffix", "category", "confidence")).alias("h")
    known = tried.join(feed, "suffix").groupBy("value").agg(hit)
    return (names.join(known, "value").select("alert_id", "kind", "pos", "value", "h.category", "h.confidence", F.lit("domain-feed").alias("feed"))
            .distinct())


def asset_values(alerts: DataFrame, values: DataFrame, assets: DataFrame) -> DataFrame:
    """(alert_id, kind, pos, value): all hosts of alerts that name none, from the source (else destination) addresses."""
    named = values.filter(F.col("kind") == "host_name").select("alert_id").distinct()
    source = values.filter(F.col("kind") == "source_ip")
    other = values.filter(F.col("kind") == "destination_ip").join(source.select("alert_id").distinct(), "alert_id", "left_anti")
    ips = source.unionByName(other).join(named, "alert_id", "left_anti").withColumnRenamed("value", "ip")
    return (ips.join(assets, "ip").groupBy("alert_id", F.col("host_name").alias("value")).agg(F.min("pos").alias("pos"))
            .select("alert_id", F.lit("host_name").alias("kind"), "pos", "value"))


def asset_hosts(alerts: DataFrame, assets: DataFrame, values: DataFrame | None = None, keep: int = ASSET_HOSTS) -> DataFrame:
    """The first hosts per alert, as shown in its row."""
    found = asset_values(alerts, listed_values(alerts) if values is None else values, assets)
    kept = first_k(found, ["alert_id"], ["pos", "value"], keep)
    return kept.groupBy("alert_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("asset_hosts"))


def is_privileged(user: Column, hints=cfg.PRIVILEGED_HINTS) -> Column:
    return F.coalesce(any_of(F.lower(user).contains(h) for h in hints), F.lit(False))


def mfa_enrolled(user: Column) -> Column:
    return ~F.coalesce(F.lower(user).startswith("svc-"), F.lit(False))


def user_risk(user: Column) -> Column:
    return F.when(is_privileged(user), 35).otherwise(10)


def host_attributes(host: Column) -> Column:
    """criticality, os and exposure from the naming scheme."""
    name = F.upper(host)
    server, client = name.rlike("^(SRV|DC-|LINUX-PROD)"), name.rlike("^(WS-|LAPTOP)")
    pick = lambda s, c: F.when(server, s).when(client, c).otherwise("unknown")
    return F.struct(pick("high", "medium").alias("criticality"),
                    pick("Windows Server 2022", "Windows 11").alias("os"),
                    pick("server-vlan", "user-vlan").alias("exposure"))


def level(value: Column, steps, below: str) -> Column:
    out = None
    for bound, name in steps:
        out = F.when(value >= bound, name) if out is None else out.when(value >= bound, name)
    return out.otherwise(below)


def triage_level(score: Column) -> Column:
    return level(score, cfg.TRIAGE_LEVELS, "close-fp")


def score_terms() -> list:
    """(applies, points, reason) per contribution, over enriched alert columns."""
    first = lambda k: F.get(entity(k), F.lit(0))
    user, host = first("user_name"), first("host_name")
    outside = F.col("outside_ip")
    kinds = F.size(F.map_filter("entities", lambda k, v: F.size(v) > 0))
    b = cfg.BOOSTS
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    conf = F.col("intel_confidence")
    return [
        (outside.isNotNull(), F.lit(b["ip_in_threat_intel"] * 0.4),
         text("external source ", outside)),
        (conf.isNotNull(), F.lit(float(b["ip_in_threat_intel"]))
         + F.greatest(F.lit(0.0), (conf - 60) / 2.0), text("threat intel: ", F.col("intel_text"))),
        (is_privileged(user), F.lit(float(b["user_is_privileged"])),
         text("privileged account ", user)),
        (~mfa_enrolled(user), F.lit(float(b["user_risk_high"])), text("MFA not enrolled")),
        (host_attributes(host)["criticality"] == "high", F.lit(float(b["host_is_critical"])),
         text("high-criticality asset ", host)),
        (kinds >= 5, F.lit(float(b["multiple_entities"])),
         text(kinds.cast("string"), " distinct entity types")),
        (F.col("max_bytes") >= cfg.LARGE_TRANSFER, F.lit(float(b["exfil_bytes_gt_100mb"])),
         text("largest single transfer ", F.bround(F.col("max_bytes") / 1e6).cast("bigint")
              .cast("string"), " MB")),
        (F.col("baseline.cov").isNotNull(), F.lit(float(cfg.BEACON_BOOST)),
         text("beaconing CoV ", F.col("baseline.cov").cast("string"))),
        (F.col("prior_events") > 0, F.lit(float(b["payload_executed"])),
         text("sequence hit (", F.col("prior_events").cast("string"), " prior events)")),
    ]


def base_score(severity: Column, risk: Column) -> Column:
    weight = None
    for name, points in cfg.SEVERITY_WEIGHT.items():
        test = severity == name
        weight = F.when(test, points) if weight is None else weight.when(test, points)
    return weight.otherwise(cfg.DEFAULT_WEIGHT).cast("double") + risk * 0.15


def enrich(alerts: DataFrame, intel_ip: DataFrame | None = None,
           intel_domain: DataFrame | None = None, prefixes: DataFrame | None = None,
           assets: DataFrame | None = None, run_ts=None, values: DataFrame | None = None,
           shown_hits: int = INTEL_HITS) -> DataFrame:
    """Scored alerts: intel hits, asset hosts, score with reasons, triage suggestion, latency.

    ``values`` is the long table of all entity values (``detect_with_values``); without it the lists
    of the alert rows are all there is.  The score uses every hit; ``intel`` shows the first
    ``shown_hits`` of ``intel_hits``.

    Lookup tables are joined plainly: Spark broadcasts them while their measured size is small
    and shuffles on the lookup key when it is not.  The alerts are written once: a dozen branches
    read them, and each would compute them anew.
    """
    spark = alerts.sparkSession
    alerts = materialize(alerts, "alerts")
    intel_ip = cfg.intel_ip(spark) if intel_ip is None else intel_ip
    intel_domain = cfg.intel_domain(spark) if intel_domain is None else intel_domain
    prefixes = cfg.geo_prefixes(spark) if prefixes is None else prefixes
    assets = cfg.assets(spark) if assets is None else assets

    values = listed_values(alerts) if values is None else values
    asked = _exploded(alerts, "source_ip", "destination_ip", "destination_domain", "dns_question_name", values=values)
    hits = match_ips(asked, intel_ip, prefixes).unionByName(match_domains(asked, intel_domain))
    rank = F.when(F.col("kind") == "source_ip", 0).when(F.col("kind") == "destination_ip", 1) \
            .when(F.col("kind") == "destination_domain", 2).otherwise(3)
    hits = materialize(hits.withColumn("r", rank), "intel-hits")
    best = hits.groupBy("alert_id").agg(F.max("confidence").alias("intel_confidence"), F.count(F.lit(1)).alias("intel_hits"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "kind", "value", "category", "confidence", "feed"))), lambda x: F.struct(
        *[x[f].alias(f) for f in ("kind", "value", "category", "confidence", "feed")]))
    few = first_k(hits, ["alert_id"], ["r", "pos", "value"], shown_hits).groupBy("alert_id").agg(listed.alias("intel"))
    outside = (values.filter((F.col("kind") == "source_ip") & ~is_internal(F.col("value"))).groupBy("alert_id")
               .agg(F.min_by("value", F.struct("pos", "value")).alias("outside_ip")))
    intel = best.join(few, "alert_id")
    hosts = asset_hosts(alerts, assets, values)
    known = F.when(F.col("asset_hosts").isNotNull(), F.map_concat(
        "entities", F.create_map(F.lit("host_name"), F.col("asset_hosts")))).otherwise(
            F.col("entities"))
    out = (alerts.join(hosts, "alert_id", "left").join(intel, "alert_id", "left").join(outside, "alert_id", "left")
           .withColumn("intel_hits", F.coalesce("intel_hits", F.lit(0)).cast("bigint"))
           .withColumn("entities", known).drop("asset_hosts")
           .withColumn("intel", F.coalesce("intel", F.array().cast(
               "array<struct<kind:string,value:string,category:string,confidence:int,feed:string>>")))
           .withColumn("intel_text", F.array_join(F.transform(
               F.slice("intel", 1, REASON_HITS), lambda h: F.concat(
                   h["value"], F.lit("="), h["category"], F.lit("(conf "),
                   h["confidence"].cast("string"), F.lit(")"))), ", ")))
    terms = [(F.coalesce(c, F.lit(False)), p, r) for c, p, r in score_terms()]
    points = base_score(F.col("severity"), F.col("risk"))
    for applies, p, _ in terms:
        points = points + F.when(applies, p).otherwise(F.lit(0.0))
    reasons = F.array_compact(F.array(
        F.concat(F.lit("rule severity "), F.col("severity"), F.lit(" + rule risk "),
                 F.col("risk").cast("string")),
        *[F.when(c, r) for c, _, r in terms]))
    out = out.withColumns({
        "score": F.bround(F.least(F.lit(float(cfg.SCORE_CAP)), points)).cast("int"),
        "score_reasons": reasons})
    out = out.withColumns({"triage_suggested": triage_level(F.col("score")),
                           "host_profile": host_attributes(F.get(entity("host_name"), F.lit(0))),
                           "user_risk": user_risk(F.get(entity("user_name"), F.lit(0)))})
    if run_ts is not None:
        at = (run_ts if isinstance(run_ts, Column) else F.lit(run_ts)).cast("timestamp")
        out = out.withColumn("detection_latency_s", F.greatest(
            F.lit(0), F.unix_seconds(at) - F.unix_seconds("last_seen")))
    return out.drop("intel_text", "intel_confidence", "outside_ip")
