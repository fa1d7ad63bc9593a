"""Lookup tables and settings shipped with the engine.

Everything in this file is a fixed value: weights, policies, and the small demo lookup tables.
Pass your own DataFrames of the same shape for real feeds.
"""
from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession

SEVERITIES = ["critical", "high", "medium", "low", "informational"]
SEVERITY_WEIGHT = {"critical": 60, "high": 45, "medium": 30, "low": 15, "informational": 5}
DEFAULT_WEIGHT = 20
BOOSTS = {"ip_in_threat_intel": 15, "user_is_privileged": 12, "user_risk_high": 8,
          "host_is_critical": 10, "multiple_entities": 5, "exfil_bytes_gt_100mb": 10,
          "payload_executed": 10}
BEACON_BOOST = 6
SCORE_CAP = 100
LARGE_TRANSFER = 100_000_000
PRIVILEGED_HINTS = ("admin", "root", "svc-", "system", "sa", "backup", "operator", ".adm")
TRIAGE_LEVELS = [(75, "escalate"), (55, "investigate"), (35, "monitor")]
PRIORITY_LEVELS = [(75, "P1"), (55, "P2"), (35, "P3")]
SLA_HOURS = {"critical": 1, "high": 4, "medium": 8, "low": 24, "informational": 72}
CORRELATION_MINUTES = 90
DETECTION_LAG_MINUTES = 4
RESPONSE_LAG_MINUTES = 18

TACTIC_ORDER = ["reconnaissance", "initial-access", "execution", "persistence",
                "privilege-escalation", "defense-evasion", "credential-access", "discovery",
                "lateral-movement", "collection", "command-and-control", "exfiltration", "impact"]

PLAYBOOKS = [
    ("block-bruteforce-source", ["credential-access", "initial-access"],
     ["block_ip_at_waf", "disable_account", "force_password_reset"]),
    ("isolate-compromised-host", ["command-and-control", "exfiltration", "impact", "persistence"],
     ["isolate_host", "kill_process_tree", "quarantine_file"]),
    ("reset-credentials-vpn", ["lateral-movement", "credential-access"],
     ["revoke_sessions", "force_password_reset", "require_mfa_reenrollment"]),
    ("advisory-only", ["discovery"], ["create_ticket"]),
]
BUILTIN_ACCOUNTS = ["system", "local service", "network service", "-", "n/a", ""]

GEO_PREFIXES = [
    ("10.0.0.0/8", "Coimbatore, IN (corporate LAN)", 11.0168, 76.9558, "private"),
    ("103.216.220.0/24", "Chennai, IN", 13.0827, 80.2707, None),
    ("104.28.55.0/24", "Singapore, SG", 1.3521, 103.8198, None),
    ("45.155.205.0/24", "Frankfurt, DE (anonymizer)", 50.1109, 8.6821, "anonymizer"),
    ("185.220.101.0/24", "Rotterdam, NL (anonymizer)", 51.9244, 4.4777, "anonymizer"),
    ("203.0.113.0/24", "Johannesburg, ZA", -26.2041, 28.0473, None),
    ("198.51.100.0/24", "Sao Paulo, BR", -23.5505, -46.6333, None),
    ("192.0.2.0/24", "Ashburn US (bulletproof hosting)", 39.0438, -77.4874, "hosting-provider"),
    ("13.107.42.0/24", "Redmond, US", 47.6740, -122.1215, None),
]
INTEL_IP = [
    ("203.0.113.44", "brute-force", "abuseipdb", 88),
    ("198.51.100.23", "scanner", "internal-honeypot", 71),
    ("192.0.2.99", "c2", "feodo-block-list", 94),
    ("45.155.205.10", "anonymizer", "tor-exit-list", 66),
    ("203.0.113.77", "info-sec-scanning", "vendor-advisory", 20),
]
ANONYMIZER_SOURCE, ANONYMIZER_CONFIDENCE = "static-anonymizer-list", 60
INTEL_DOMAIN = [
    ("login-secure-ms.com", "phishing", 91),
    ("exfil-drop.cloud", "exfil-host", 84),
    ("cdn-update-service.net", "c2", 90),
    ("a1f3-update.net", "dga", 76),
]
ASSETS = [
    ("10.10.31.27", "WS-FINANCE-07"), ("10.10.31.44", "WS-HR-03"), ("10.10.31.58", "WS-ENG-12"),
    ("10.10.31.61", "WS-MKT-02"), ("10.10.31.73", "WS-OPS-09"), ("10.10.20.11", "SRV-BKP-01"),
    ("10.10.10.5", "DC-01"), ("10.10.20.30", "SRV-WEB-01"), ("10.10.20.40", "SRV-FILE-01"),
]


def geo_prefixes(spark: SparkSession, rows=GEO_PREFIXES) -> DataFrame:
    """(cidr, label, lat, lon, category, prefix_len, network); ``network`` is the first IPv4 address as a number."""
    def expand(cidr, *rest):
        net = ipaddress.ip_network(cidr)
        return (cidr, *rest, net.prefixlen, int(net.network_address) if net.version == 4 else None)
    return spark.createDataFrame([expand(*r) for r in rows], "cidr string, label string, lat double, lon double, "
                                 "category string, prefix_len int, network bigint")


def intel_ip(spark, rows=INTEL_IP) -> DataFrame:
    return spark.createDataFrame(rows, "ip string, category string, feed string, confidence int")


def intel_domain(spark, rows=INTEL_DOMAIN) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)],
                                 "suffix string, category string, confidence int, feed_rank int")


def assets(spark, rows=ASSETS) -> DataFrame:
    return spark.createDataFrame(rows, "ip string, host_name string")


def playbooks(spark, rows=PLAYBOOKS) -> DataFrame:
    """One row per (playbook, tactic, action) with the order in which actions are listed."""
    flat = [(n, t, a, p * 100 + i) for p, (n, tactics, actions) in enumerate(rows)
            for t in tactics for i, a in enumerate(actions)]
    return spark.createDataFrame(flat, "playbook string, tactic string, action string, step int")
