"""Data model: schemas, severity scale and the constant tables the operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# --- Fixed values: names and numbers that results depend on. ---------------

# Promoted event attributes, in schema order.
PROMOTED = (
    "event_id", "timestamp", "host", "user", "process_guid", "parent_process_guid", "process_id",
    "image", "parent_image", "command_line", "parent_command_line",
)

# Payload keys feeding each promoted attribute, highest priority first.
PROMOTION_ORDER = {
    "image": ("SourceImage", "Image"),
    "parent_image": ("ParentImage",),
    "command_line": ("CommandLine",),
    "parent_command_line": ("ParentCommandLine",),
    "process_guid": ("SourceProcessGUID", "SourceProcessGuid", "ProcessGuid"),
    "parent_process_guid": ("ParentProcessGuid",),
    "process_id": ("SourceProcessId", "ProcessId"),
    "user": ("User",),
}

# Raw payload key -> forensic field name.
FORENSIC_FIELDS = {
    "User": "user", "IntegrityLevel": "integrity_level", "LogonId": "logon_id",
    "ProcessId": "process_id", "ParentProcessId": "parent_process_id",
    "ParentCommandLine": "parent_command_line", "CurrentDirectory": "current_directory",
    "Hashes": "hashes", "TerminalSessionId": "session_id", "OriginalFileName": "original_file_name",
    "Company": "company", "Product": "product", "DestinationIp": "destination_ip",
    "DestinationPort": "destination_port", "DestinationHostname": "destination_hostname",
    "TargetImage": "target_image", "TargetFilename": "target_filename", "TargetObject": "registry_key",
    "GrantedAccess": "granted_access", "PipeName": "pipe_name", "QueryName": "dns_query",
}

SEVERITIES = ("info", "low", "medium", "high", "critical")
SEVERITY_WEIGHT = {"info": 1, "low": 3, "medium": 5, "high": 8, "critical": 14}
SCORE_BANDS = ((14, "critical"), (8, "high"), (5, "medium"), (2, "low"))
STATUSES = ("open", "closed", "false_positive")

SYSMON_CHANNEL = "Microsoft-Windows-Sysmon/Operational"
MAX_EVENT_BYTES = 1_000_000
MAX_NOTE_WORDS = 500
PROCESS_CREATE, NETWORK_CONNECT = 1, 3

# Images whose regular or broad network use is expected (beacon and scan).
EXCLUDED_IMAGES = (
    "chrome.exe", "msedge.exe", "firefox.exe", "svchost.exe", "onedrive.exe", "teams.exe", "slack.exe",
)

BEACON_RULE, BEACON_TECHNIQUES = "BCN-001", ("T1071.001", "T1573")
DISCOVERY_RULE = "DSC-001"
SCAN_RULE, SCAN_TECHNIQUE, SWEEP_TECHNIQUE = "SCN-001", "T1046", "T1018"

# Detectors counted by the coverage report, and the techniques they raise.
DETECTOR_TECHNIQUES = (
    "T1071.001", "T1573", "T1016", "T1018", "T1033", "T1049", "T1057", "T1069", "T1082", "T1087",
)

INTEGRITY_ORDER = ("untrusted", "low", "medium", "high", "system")

# Correlation, tree and noise defaults.
INCIDENT_WINDOW_S = 600
ACTIONABLE_SCORE = 12
ACTIONABLE_COUNT = 3
PROCESS_TTL_S = 7200

# Ordered recon signatures: the first pattern found names the technique.
DISCOVERY_SIGNATURES = (
    ("T1069", "permission groups", r'\bnet\d?\s+group\s+"?domain admins'),
    ("T1069", "permission groups", r"\bnltest\b|\bget-adgroupmember\b"),
    ("T1033", "current user", r"\bwhoami\b"),
    ("T1087", "account discovery", r"\bnet\d?\s+(user|group|localgroup|accounts)\b"),
    ("T1087", "account discovery", r"\bget-aduser\b|\bget-adgroup\b|\bdsquery\b"),
    ("T1016", "network config", r"\bipconfig\b|\bnetsh\b|\bget-netipconfiguration\b"),
    ("T1016", "network config", r"\bnbtstat\b|\barp\s+-a\b|\broute\s+print\b"),
    ("T1082", "system info", r"\bsysteminfo\b|\bwmic\s+(os|computersystem|bios)\b"),
    ("T1082", "system info", r"\bget-wmiobject\b|\bget-ciminstance\b"),
    ("T1018", "remote systems", r"\bnet\d?\s+view\b|\bdsquery\s+computer\b"),
    ("T1057", "process discovery", r"\btasklist\b|\bget-process\b|\bqprocess\b"),
    ("T1049", "network connections", r"\bnetstat\b\s+-[a-z]*n"),
)

# Tactic -> techniques, as incident titles group them.
TITLE_TACTICS = {
    "delivery": ("T1566", "T1566.001"),
    "execution": (
        "T1204", "T1204.001", "T1204.002", "T1204.004", "T1059", "T1059.001", "T1027", "T1047", "T1569.002",
        "T1204.003", "T1059.005",
    ),
    "download": ("T1105", "T1218", "T1218.011", "T1218.008", "T1218.014"),
    "persistence": (
        "T1547.001", "T1546.012", "T1053.005", "T1098", "T1136.001", "T1505.003", "T1543.003", "T1546.003",
        "T1546.015", "T1546.008", "T1547.004", "T1547.005", "T1547.014", "T1136.002",
    ),
    "defense-evasion": (
        "T1685", "T1562.001", "T1070.001", "T1070.004", "T1127.001", "T1134", "T1134.001", "T1140", "T1197",
        "T1202", "T1211", "T1216", "T1548.002", "T1562.004", "T1070.006", "T1564.004", "T1006", "T1562.002",
        "T1562.009", "T1562.006", "T1112", "T1564.001", "T1574.001", "T1574.002", "T1553.004",
    ),
    "masquerading": ("T1036.005", "T1036.007"),
    "credential-access": (
        "T1003.001", "T1552.001", "T1003", "T1558.003", "T1552.004", "T1552.005", "T1555.003", "T1555", "T1558.004",
        "T1003.004", "T1003.005", "T1558.001", "T1552.002", "T1552.006", "T1003.003",
    ),
    "discovery": (
        "T1087", "T1082", "T1016", "T1033", "T1069", "T1018", "T1057", "T1049", "T1046", "T1482", "T1083",
        "T1518.001",
    ),
    "command-and-control": (
        "T1071", "T1071.001", "T1573", "T1090.001", "T1571", "T1219", "T1102", "T1568", "T1090.003",
    ),
    "injection": ("T1055", "T1055.012"),
    "impact": ("T1490", "T1486", "T1489", "T1491.001", "T1485", "T1531"),
    "initial-access": ("T1190",),
    "lateral-movement": (
        "T1021.001", "T1021.002", "T1021.006", "T1563.002", "T1550.002", "T1550.003", "T1021.003", "T1021.004",
    ),
    "collection": ("T1560.001", "T1113", "T1115", "T1074", "T1119", "T1560.002"),
    "exfiltration": ("T1567.002", "T1048"),
    "privilege-escalation": ("T1484.001", "T1484.002", "T1611"),
}

# Where the behaviour narrative groups techniques differently from the titles:
# it has no delivery, download or masquerading phase, and keeps one injection id.
NARRATIVE_TACTICS = {
    "initial-access": ("T1566", "T1566.001", "T1190"),
    "execution": (
        "T1204", "T1204.002", "T1204.001", "T1204.004", "T1059", "T1059.001", "T1027", "T1059.005", "T1059.007",
        "T1047", "T1569.002", "T1204.003",
    ),
    "command-and-control": (
        "T1105", "T1071", "T1071.001", "T1573", "T1571", "T1090.001", "T1219", "T1102", "T1568", "T1090.003",
    ),
    "defense-evasion": (
        "T1218", "T1218.011", "T1218.002", "T1036.005", "T1562.001", "T1685", "T1055", "T1070.001", "T1070.004",
        "T1127.001", "T1134", "T1134.001", "T1140", "T1197", "T1202", "T1211", "T1216", "T1548.002", "T1562.004",
        "T1070.006", "T1564.004", "T1006", "T1218.008", "T1218.014", "T1562.002", "T1562.009", "T1036.007",
        "T1562.006", "T1112", "T1564.001", "T1574.001", "T1574.002", "T1553.004",
    ),
    "persistence": TITLE_TACTICS["persistence"],
    "credential-access": TITLE_TACTICS["credential-access"],
    "discovery": TITLE_TACTICS["discovery"],
    "impact": TITLE_TACTICS["impact"],
    "lateral-movement": TITLE_TACTICS["lateral-movement"],
    "collection": TITLE_TACTICS["collection"],
    "exfiltration": TITLE_TACTICS["exfiltration"],
    "privilege-escalation": TITLE_TACTICS["privilege-escalation"],
    "injection": ("T1055.012",),
}

PHASE_ORDER = (
    "initial-access", "execution", "privilege-escalation", "defense-evasion", "discovery",
    "lateral-movement", "credential-access", "persistence", "collection", "command-and-control",
    "exfiltration", "impact",
)

TACTIC_LABELS = {
    "delivery": "Phishing delivery", "initial-access": "Initial access", "execution": "Suspicious execution",
    "download": "Payload download", "persistence": "Persistence", "defense-evasion": "Defense evasion",
    "masquerading": "Process masquerading", "credential-access": "Credential access",
    "discovery": "Host reconnaissance", "lateral-movement": "Lateral movement",
    "privilege-escalation": "Privilege escalation", "collection": "Data collection",
    "command-and-control": "C2 communication", "exfiltration": "Data exfiltration",
    "injection": "Process injection", "impact": "Destructive activity",
}

# Title narratives: every tactic of the set present; first match wins.
NARRATIVES = (
    (("delivery", "discovery", "execution"), "Phishing to reconnaissance"),
    (("command-and-control", "delivery", "execution"), "Phishing to C2"),
    (("command-and-control", "credential-access"), "Credential access with C2"),
    (("delivery", "execution"), "Phishing execution chain"),
    (("command-and-control", "execution"), "Execution with C2"),
    (("command-and-control", "discovery"), "Reconnaissance with C2"),
    (("credential-access", "discovery"), "Credential access after recon"),
)

SIGNATURE_TITLES = (
    ("SYS-004", "Ransomware preparation"), ("SYS-041", "Credential theft"),
    ("SYS-038", "IIS credential theft"), ("SYS-010", "Credential theft"),
    ("SYS-060", "Named-pipe C2"), ("SYS-031", "Defender tampering"),
    ("SYS-151", "ClickFix social engineering"), ("BCN-001", "C2 beacon"),
    ("DSC-001", "Host reconnaissance"), ("SCN-001", "Network scan"),
)

# Correlation chains: every (minimum, rule ids) requirement holds; first match wins.
CHAINS = (
    ("ransomware", "Ransomware activity chain",
     ((1, ("SYS-004",)), (1, ("SYS-080", "SYS-081")))),
    ("credential-theft-campaign", "Credential theft campaign",
     ((2, ("SYS-010", "SYS-041", "SYS-118", "SYS-130", "SYS-131", "SYS-135", "SYS-136", "SYS-137", "SYS-150")),)),
    ("office-to-powershell", "Office to PowerShell infection chain",
     ((1, ("SYS-001",)), (1, ("SYS-009",)))),
)

HISTOGRAM_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
# --- End of fixed values. ---------------------------------------------------

EVENT_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("event_uid", T.StringType()),
    T.StructField("event_id", T.IntegerType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("host", T.StringType()), T.StructField("user", T.StringType()),
    T.StructField("process_guid", T.StringType()), T.StructField("parent_process_guid", T.StringType()),
    T.StructField("process_id", T.IntegerType()), T.StructField("image", T.StringType()),
    T.StructField("parent_image", T.StringType()), T.StructField("command_line", T.StringType()),
    T.StructField("parent_command_line", T.StringType()),
    T.StructField("raw", T.MapType(T.StringType(), T.StringType())),
])

# Columns every detection frame carries, whatever produced it. `source` orders
# detections raised by one event: rules, then beacon, discovery, scan.
DETECTION_COLUMNS = (
    "seq", "source", "rule_id", "title", "severity", "attack", "host", "image", "parent_image",
    "command_line", "process_guid", "evidence", "matched_at", "raw",
)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.lit(list(SEVERITIES)), F.lower(severity)).cast("int") - 1


def severity_weight(severity: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in SEVERITY_WEIGHT.items() for x in kv])
    return weights[F.lower(severity)]


def score_severity(score: Column) -> Column:
    banded = F.lit("info")
    for floor, name in reversed(SCORE_BANDS):
        banded = F.when(score >= floor, name).otherwise(banded)
    return banded


def tactic_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for tactic, ids in table.items() for t in ids for x in (t, tactic)])


def technique_tactic(technique: Column, table: dict[str, tuple[str, ...]] = TITLE_TACTICS) -> Column:
    """Tactic of a technique, falling back to the parent technique."""
    lookup = tactic_map(table)
    return F.coalesce(lookup[technique], lookup[F.substring_index(technique, ".", 1)])


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts)
