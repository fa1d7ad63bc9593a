"""The shipped rule pack.

Fixed values: ids, severities, techniques, scopes, patterns and limits of each detection.
Rules that are meant to count distinct values say so through ``min_distinct``.
"""
from __future__ import annotations

LOGON_SCOPE = ["authentication", "auth"]
FAILED = ["failed-logon", "authentication-failure"]
SUCCEEDED = ["successful-logon", "authentication-success"]


def _rule(rid, name, severity, confidence, risk, tactic, technique, scope, condition, **more):
    return {"id": rid, "name": name, "severity": severity, "confidence": confidence, "risk": risk,
            "tactic": tactic, "technique": technique, "logsource": {"dataset": scope},
            "condition": condition, **more}


def _count(field, events, minutes, distinct=None, min_distinct=None):
    doc = {"field": [field], "min_events": events, "window_minutes": minutes}
    if distinct:
        doc.update(distinct_field=distinct, min_distinct=min_distinct)
    return doc


def _regex(field, *patterns):
    return [{field: {"regex": p}} for p in patterns]


RULES = [
    # ---- identity
    _rule("SOC-BRUTE-001", "External brute force on logons", "high", "high", 70,
          "credential-access", ["T1110", "T1110.003"], LOGON_SCOPE,
          [{"event.action": FAILED, "source.ip": {"exists": True}, "source.ip_not_private": True}],
          threshold=_count("source.ip", 30, 15)),
    _rule("SOC-BRUTE-002", "SSH brute force", "medium", "high", 55,
          "credential-access", ["T1110", "T1021.004"], ["auth"],
          [{"event.action": "authentication-failure", "source.ip": {"exists": True}}],
          threshold=_count("source.ip", 10, 10)),
    _rule("SOC-LOGIN-003", "External logon right after brute force", "critical", "high", 90,
          "initial-access", ["T1078", "T1078.004"], LOGON_SCOPE,
          [{"event.action": SUCCEEDED, "source.ip": {"exists": True},
            "source.ip_not_private": True}],
          requires={"condition": [{"event.action": FAILED, "source.ip_not_private": True}],
                    "min_count": 10, "window_minutes": 30, "key_fields": ["source.ip"]}),
    _rule("SOC-CSTUF-004", "Password spray over many accounts", "medium", "medium", 50,
          "credential-access", ["T1110.004"], LOGON_SCOPE,
          [{"event.action": FAILED, "source.ip_not_private": True}],
          threshold=_count("source.ip", 6, 15, "user.name", 6)),
    _rule("SOC-IMPTVL-005", "Impossible travel", "high", "medium", 65,
          "initial-access", ["T1078"], LOGON_SCOPE,
          [{"event.action": SUCCEEDED, "source.ip": {"exists": True},
            "source.ip_not_private": True}],
          window={"group_by": ["user.name"], "span_minutes": 60, "geo_field": "source.ip",
                  "min_distance_km": 400}),
    _rule("SOC-OWA-006", "Web-mail logon failures", "low", "low", 20,
          "credential-access", ["T1110.001"], ["web"],
          [{"url.path": {"wildcard": "*auth.owa*"}, "http.response.status_code": 401}],
          threshold=_count("source.ip", 5, 15)),
    _rule("SOC-ACCT-007", "New account made privileged", "high", "high", 75,
          "persistence", ["T1136.001", "T1098.003"], LOGON_SCOPE, [{"event.id": "4732"}],
          requires={"condition": [{"event.id": "4720"}], "min_count": 1, "window_minutes": 20,
                    "key_fields": ["user.name"]}),
    # ---- endpoint
    _rule("SOC-PSH-010", "Obfuscated or downloading PowerShell", "high", "high", 80,
          "execution", ["T1059.001"], ["process_creation", "authentication"],
          [{"process.name": {"wildcard": "*powershell*"},
            "@any_of": _regex(
                "process.command_line",
                r"(?i)-enc(odedcommand)?\s+[A-Za-z0-9+/=]{16,}",
                r"(?i)(downloadstring|downloadfile|iex\s*\(|invoke-expression|invoke-webrequest)",
                r"(?i)(amsi.*stop|amsinitdisable)")}],
          filter=[{"process.command_line": {"wildcard": "*githubusercontent.com*"}},
                  {"user.name": {"wildcard": "svc-deploy*"}}]),
    _rule("SOC-PERSIST-011", "Autostart into a user-writable path", "high", "high", 75,
          "persistence", ["T1053.005", "T1547.001"], ["process_creation", "registry"],
          _regex("process.command_line", r"(?i)schtasks\s+/create.*appdata",
                 r"(?i)schtasks\s+/create.*\\temp\\")
          + [{"registry.key": {"regex": r"(?i)(schedule\\taskcache|currentversion\\run)"},
              "registry.value": {"regex": r"(?i)(appdata|\\temp\\)"}}]),
    _rule("SOC-PROC-012", "Office application spawns a shell", "high", "medium", 70,
          "execution", ["T1204.002", "T1059"], ["process_creation"],
          [{"process.parent": {"regex": r"(?i)(outlook|winword|excel|powerpnt|acrord32)\.exe$"},
            "process.name": {"regex":
                             r"(?i)^(cmd|powershell|wscript|cscript|mshta|rundll32)\.exe$"}}],
          filter=[{"process.command_line": {"wildcard": "*-noprofile -help*"}}]),
    _rule("SOC-CRED-013", "Handle opened on lsass", "critical", "high", 95,
          "credential-access", ["T1003.001"], ["process_access"],
          [{"target.process": {"wildcard": "*lsass.exe*"},
            "access_mask": {"regex": r"(?i)^0x(10|14|1010|1000|1fffff|1f0fff)$"}}]),
    _rule("SOC-EVADE-014", "Shadow copies deleted", "critical", "high", 92,
          "defense-evasion", ["T1490"], ["process_creation"],
          _regex("process.command_line", r"(?i)vssadmin.*delete\s+shadows",
                 r"(?i)wmic.*shadowcopy\s+(call\s+)?delete",
                 r"(?i)dism.*disable-feature.*bitlocker")),
    _rule("SOC-EVADE-015", "Event log cleared", "high", "high", 78,
          "defense-evasion", ["T1070.001"],
          ["process_creation", "log_clearing", "authentication"],
          _regex("process.command_line", r"(?i)wevtutil\s+cl|clear-eventlog")
          + [{"event.id": "1102"}],
          filter=[{"user.name": {"wildcard": "svc-siemrotate*"}}]),
    _rule("SOC-EVADE-016", "Host firewall switched off", "medium", "high", 55,
          "defense-evasion", ["T1562.004"], ["process_creation"],
          _regex("process.command_line", r"(?i)netsh\s+advfirewall\s+set.*state\s+off",
                 r"(?i)set-netfirewallprofile.*disabled")),
    _rule("SOC-DISC-017", "Burst of discovery commands", "low", "medium", 30,
          "discovery", ["T1087.002", "T1082", "T1018"], ["process_creation"],
          _regex("process.command_line", r"(?i)net\s+user\s+\S+\s+/domain",
                 r"(?i)nltest\s+/dclist", r"(?i)whoami\s+/priv", r"(?i)systeminfo(\s|$)",
                 r"(?i)net\s+view(\s|$|\\)"),
          threshold=_count("host.name", 3, 10)),
    # ---- network
    _rule("SOC-SCAN-020", "Vertical port scan", "medium", "high", 45,
          "reconnaissance", ["T1595.001", "T1046"], ["firewall"],
          [{"event.action": ["deny", "drop", "reject"], "destination.port": {"exists": True}}],
          threshold=_count("source.ip", 10, 5, "destination.port", 10),
          filter=[{"source.ip": ["203.0.113.77"]}]),
    _rule("SOC-C2-021", "Beacon-shaped URI", "high", "high", 80,
          "command-and-control", ["T1071.001", "T1105"], ["web", "proxy"],
          _regex("url.path", r"(?i)/(submit/[a-z]{2,10}\.php|gate\.php|load\.php|pixel\.gif"
                             r"|cacert\.a[0-9]{2})")),
    _rule("SOC-C2-022", "Traffic to a listed domain", "critical", "high", 88,
          "command-and-control", ["T1071", "T1105"], ["web", "proxy", "dns"],
          [{"destination.domain": ["cdn-update-service.net", "login-secure-ms.com",
                                   "exfil-drop.cloud"]},
           {"dns.question.name": {"wildcard": "*cdn-update-service.net*"}}]),
    _rule("SOC-C2-023", "Machine-regular polling", "high", "medium", 72,
          "command-and-control", ["T1071.001", "T1029"], ["web", "proxy"],
          [{"network.direction": "outbound", "process.name": {"exists": True}}],
          config={"group_by": ["source.ip", "destination.domain"],
                  "threshold": {"min_events": 12, "window_minutes": 30},
                  "time_stats": {"max_cov": 0.08, "min_interval_s": 20, "max_interval_s": 600},
                  "exclude_processes": ["chrome.exe", "firefox.exe", "msedge.exe", "teams.exe",
                                        "outlook.exe", "code.exe", "spotify.exe", "onedrive.exe",
                                        "searchapp.exe", "nissrv.exe"]}),
    _rule("SOC-EXFIL-024", "Large outbound transfer", "high", "medium", 76,
          "exfiltration", ["T1048", "T1567.002"], ["web", "proxy", "firewall"],
          [{"@any_of": [{"network.bytes": {"gte": 100000000}},
                        {"bytes_sent": {"gte": 100000000}}]}],
          threshold=_count("source.ip", 1, 30)),
    _rule("SOC-EXFIL-025", "SMB leaving the network", "medium", "low", 48,
          "exfiltration", ["T1048.002"], ["firewall"],
          [{"destination.port": 445, "destination.ip_not_private": True,
            "event.action": ["allow", "accept"]}]),
    _rule("SOC-DGA-026", "Generated or dynamic DNS names", "medium", "high", 60,
          "command-and-control", ["T1568.002", "T1583.001"], ["dns"],
          _regex("dns.question.name",
                 r"(?i)([a-z0-9]{12,}\.(net|com|org)|\.(noip|duckdns|dynv6|hopto)\.(org|net)"
                 r"|-update\.net$)"),
          threshold=_count("source.ip", 4, 15)),
    _rule("SOC-DNSTUN-027", "Oversized DNS answers", "high", "medium", 70,
          "exfiltration", ["T1071.004", "T1048.003"], ["dns"],
          [{"network.bytes": {"gte": 2500}}], threshold=_count("source.ip", 10, 15)),
    _rule("SOC-DNS-028", "Generated name that resolved", "medium", "medium", 66,
          "command-and-control", ["T1568.002"], ["dns"],
          [{"dns.rcode": "NOERROR",
            "dns.question.name": {"regex": r"(?i)[a-z0-9]{6,}\.a1f3-update\.net"}}],
          threshold=_count("source.ip", 1, 15)),
    # ---- data protection, web exploits, lateral movement
    _rule("SOC-RANSOM-030", "Mass file encryption", "critical", "high", 98,
          "impact", ["T1486", "T1489"], ["file_event", "process_creation"],
          _regex("file.path",
                 r"(?i)\.(locked|encrypted|crypt|locked-[a-z0-9]{4,}|xyz26|encrypt)$"),
          threshold=_count("host.name", 25, 10)),
    _rule("SOC-RANSOM-031", "Ransom note written", "critical", "high", 95,
          "impact", ["T1486", "T1489"], ["file_event", "process_creation"],
          _regex("file.path", r"(?i)(readme.*decrypt|how_to_recover|!!read_me|restore_files"
                              r"|ransom)\.(txt|html|hta)$")),
    _rule("SOC-DESTROY-032", "Mass deletion of user files", "high", "medium", 82,
          "impact", ["T1485", "T1490"], ["file_event", "process_creation"],
          [{"event.action": ["file-delete", "delete"],
            "file.path": {"regex": r'(?i)\\(?:users|home)\\[^"]*\\'
                                   r"(?:documents|desktop|downloads|finance|shared)\\"}}],
          threshold=_count("host.name", 20, 15)),
    _rule("SOC-INIT-033", "Web exploit attempt", "high", "medium", 68,
          "initial-access", ["T1190"], ["web"],
          _regex("url.path",
                 r"(?i)(\$\{jndi:|\$\{lower:|\.\./\.\./\.\./etc/passwd|/\.env$|/actuator/"
                 r"|/cgi-bin/)",
                 r"(?i)(\bor\b\s+1\s*=\s*1|union\s+select)")),
    _rule("SOC-LATERAL-034", "SMB after a suspicious process", "high", "low", 62,
          "lateral-movement", ["T1021.002"], ["firewall"],
          [{"destination.port": 445, "event.action": ["allow", "accept"],
            "source.ip": {"exists": True}}],
          requires={"condition": [{"@any_of": [
              {"process.name": {"wildcard": "*powershell*"}},
              {"process.name": {"regex": r"(?i)^(mshta|rundll32|svcmon|svchost)\.exe$"}}]}],
              "min_count": 1, "window_minutes": 60, "key_fields": ["host.name"]}),
]
