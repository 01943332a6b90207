"""What an incident is made of: indicators, privilege change, behaviour, report content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.functions.scalars import basename, forensic_fields, integrity_rank, parse_hashes, present
from emberwatch.model import INTEGRITY_ORDER, NARRATIVE_TACTICS, PHASE_ORDER, tactic_map, technique_tactic


def indicators(members: DataFrame) -> DataFrame:
    """Distinct indicators as rows: (incident_id, kind, value, detail, image, us, seq), first sighting kept.

    Kinds: user, destination (detail `port|hostname`), hash (first image per
    SHA256), registry. One row per value, so a busy incident stays spread out.
    """
    raw = F.col("raw")
    sha = parse_hashes(raw["Hashes"])["sha256"]
    text = lambda key: F.coalesce(raw[key], F.lit(""))
    none = F.lit(None).cast("string")
    entry = lambda kind, value, detail, image: F.struct(
        F.lit(kind).alias("kind"), present(value).alias("value"), detail.alias("detail"), image.alias("image"))
    entries = F.array(
        entry("user", raw["User"], none, none),
        entry("destination", raw["DestinationIp"],
              F.concat_ws("|", text("DestinationPort"), text("DestinationHostname")), none),
        entry("hash", sha, none, F.coalesce(basename(F.col("image")), F.lit("unknown"))),
        entry("registry", raw["TargetObject"], none, none),
    )
    rows = members.select("incident_id", "us", "seq", "source", "rule_id", F.explode(entries).alias("e")).filter("e.value IS NOT NULL")
    first = F.struct("us", "seq", "source", "rule_id")
    return rows.groupBy("incident_id", "e.kind", "e.value", "e.detail").agg(
        F.min_by("e.image", first).alias("image"), F.min(first).alias("_first")
    ).select("incident_id", "kind", "value", "detail", "image", F.col("_first.us").alias("us"), F.col("_first.seq").alias("seq"))


def privilege_escalation(members: DataFrame) -> DataFrame:
    """(incident_id, from_level, to_level) where at least two readings show a rise."""
    rank = integrity_rank(F.col("raw")["IntegrityLevel"])
    levels = F.lit(list(INTEGRITY_ORDER))
    return (
        members.withColumn("_rank", rank).groupBy("incident_id")
        .agg(F.count("_rank").alias("_n"), F.min("_rank").alias("_lo"), F.max("_rank").alias("_hi"))
        .filter("_n >= 2 AND _hi > _lo")
        .select("incident_id", F.get(levels, F.col("_lo")).alias("from_level"), F.get(levels, F.col("_hi")).alias("to_level"))
    )


# Narrative phrases. Per tactic, (rule ids, techniques, phrase) in
# order; the first whose rules or techniques occur is used, and the last entry,
# which names neither, is the default.
PHRASES = {
    "initial-access": (
        ((), ("T1190",), "gained initial access by exploiting a public-facing application"),
        ((), (), "gained initial access through a phishing document"),
    ),
    "execution": (
        (("SYS-002", "SYS-009"), (), "executed an obfuscated PowerShell payload in memory"),
        (("SYS-035",), (), "executed an encoded script via the Windows Script Host"),
        ((), ("T1204.003",), "executed a payload mounted from a downloaded ISO or IMG disk image"),
        ((), (), "executed a suspicious payload"),
    ),
    "privilege-escalation": (
        ((), ("T1611",), "escaped a privileged container to reach the underlying host"),
        ((), ("T1484.001", "T1484.002"), "escalated privileges by abusing Group Policy or a domain trust"),
        ((), (), "escalated privileges"),
    ),
    "credential-access": (
        (("SYS-038",), (), "harvested IIS application-pool credentials via appcmd"),
        ((), ("T1558.001",), "forged a Kerberos golden ticket to impersonate a privileged account"),
        ((), ("T1003.004", "T1003.005"), "dumped LSA secrets or cached domain credentials from memory"),
        ((), ("T1552.006",), "harvested cleartext credentials from Group Policy Preferences"),
        ((), ("T1552.002",), "recovered a plaintext autologon password from the registry"),
        ((), (), "accessed credential material from LSASS memory"),
    ),
    "persistence": (
        (("SYS-030",), (), "established persistence via a registry Run key"),
        (("SYS-050",), (), "established persistence via the Startup folder"),
        ((), ("T1053.005",), "established persistence via a scheduled task"),
        ((), ("T1543.003",), "established persistence via a new Windows service"),
        ((), ("T1546.003", "T1546.015"), "established persistence via an event-triggered execution hook"),
        ((), ("T1546.008",), "backdoored a Windows accessibility feature for SYSTEM access at logon"),
        ((), ("T1547.004", "T1547.005", "T1547.014"),
         "established persistence via a Winlogon, LSA, or Active Setup registry hook"),
        ((), ("T1136.002",), "created a new domain account for standing access"),
        ((), (), "established persistence"),
    ),
    "lateral-movement": (
        ((), ("T1563.002",), "hijacked an existing RDP session to move laterally"),
        ((), ("T1021.004",), "moved laterally over SSH using a private key"),
        ((), (), "moved laterally to another host on the network"),
    ),
    "collection": (((), (), "staged and archived data ahead of exfiltration"),),
    "command-and-control": (
        (("SYS-060",), (), "established C2 over a named pipe matching a known framework default"),
        ((), ("T1090.003",), "routed C2 traffic through Tor or a multi-hop anonymizing proxy"),
        ((), (), "communicated with a remote command-and-control host"),
    ),
    "exfiltration": (((), (), "exfiltrated data to an external service"),),
    "discovery": (((), (), "performed host reconnaissance"),),
    "impact": (
        (("SYS-004",), (), "inhibited recovery by deleting volume shadow copies (ransomware precursor)"),
        ((), (), "carried out destructive actions on the host"),
    ),
}
# Defence-evasion details, all that apply, in this order.
EVASION_DETAILS = (
    (("SYS-031",), (), "disabled Windows Defender"), (("SYS-008",), (), "used rundll32 as a signed C2 host"),
    (("SYS-003",), (), "staged a payload with a living-off-the-land binary"),
    (("SYS-007",), (), "masqueraded as a system process"),
    (("SYS-034",), (), "ran a malicious .cpl disguised as a document"),
    (("SYS-036",), (), "used rundll32 to launch a script host"),
    (("SYS-037",), (), "executed a payload via rundll32 url.dll handlers"),
    ((), ("T1562.009",), "rebooted into Safe Mode to bypass security tooling"),
    ((), ("T1562.002",), "disabled Windows event logging"),
    ((), ("T1036.007",), "masqueraded a payload behind a double file extension"),
)


def _occurs(rules: tuple, techniques: tuple) -> Column:
    tests = [F.array_contains("rule_ids", r) for r in rules] + [F.array_contains("_techniques", t) for t in techniques]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)


def _phrase() -> Column:
    """Phrase of one (incident, tactic) group from its rules, techniques and measured evidence."""
    details = F.array_compact(F.array(*[F.when(_occurs(r, t), F.lit(text)) for r, t, text in EVASION_DETAILS]))
    evasion = F.when(
        F.size(details) > 0, F.concat(F.lit("evaded defenses ("), F.array_join(details, ", "), F.lit(")"))
    ).otherwise("took steps to evade defenses")
    out = F.when(F.col("tactic") == "defense-evasion", evasion)
    for tactic, options in PHRASES.items():
        text = None
        for rules, techniques, phrase in options:
            test = _occurs(rules, techniques)
            text = F.when(test, phrase) if text is None else text.when(test, phrase)
        if tactic == "discovery":
            measured = F.concat(F.lit("performed host reconnaissance across "), F.col("_breadth"), F.lit(" distinct techniques"))
            text = F.coalesce(measured, text)
        if tactic == "command-and-control":
            seconds = F.bround(F.col("_interval").cast("double")).cast("bigint").cast("string")
            measured = F.concat(F.lit("established C2, beaconing to a remote host every ~"), seconds, F.lit("s"))
            text = F.coalesce(measured, text)
        out = out.when(F.col("tactic") == tactic, text)
    return out


def behavior_phases(members: DataFrame) -> DataFrame:
    """(incident_id, position, tactic, phrase, techniques, rules) in kill-chain order.

    A technique finds its phase through its parent when it is not listed; only
    listed ones are then named in the phase.
    """
    tactics = F.array_distinct(F.array_compact(F.transform("attack", lambda t: technique_tactic(t, NARRATIVE_TACTICS))))
    per_tactic = members.withColumn("tactic", F.explode(tactics))
    order = F.struct("us", "seq", "source", "rule_id")
    evidence = F.col("evidence")
    measured = lambda key: F.when(~evidence[key].isin("", "0", "0.0"), evidence[key])
    grouped = per_tactic.groupBy("incident_id", "tactic").agg(
        F.sort_array(F.collect_set("rule_id")).alias("rule_ids"),
        F.array_distinct(F.flatten(F.collect_set("attack"))).alias("_techniques"),
        F.min_by(measured("distinct_techniques"), F.when(measured("distinct_techniques").isNotNull(), order)).alias("_breadth"),
        F.min_by(measured("median_interval_seconds"), F.when(measured("median_interval_seconds").isNotNull(), order)).alias("_interval"),
    )
    position = F.array_position(F.lit(list(PHASE_ORDER)), F.col("tactic")).cast("int")
    exact = tactic_map(NARRATIVE_TACTICS)
    return (
        grouped.withColumn("position", position).filter("position > 0")
        .select(
            "incident_id", "position", "tactic", _phrase().alias("phrase"),
            F.array_sort(F.filter("_techniques", lambda t: exact[t] == F.col("tactic"))).alias("techniques"),
            F.col("rule_ids").alias("rules"),
        )
        .withColumn("tactic", F.replace("tactic", F.lit("-"), F.lit(" ")))
    )


def behavior_profile(incidents: DataFrame, phases: DataFrame) -> DataFrame:
    """(incident_id, phases, summary): at most one phase per tactic, so the list is short."""
    listed = phases.groupBy("incident_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "tactic", "phrase", "techniques", "rules"))).alias("phases")
    )
    phrases = F.transform("phases", lambda p: p["phrase"])
    n = F.size("phases")
    body = F.when(n == 1, F.get(phrases, F.lit(0))).otherwise(
        F.concat(F.array_join(F.slice(phrases, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(phrases, -1))
    )
    summary = F.when(
        F.col("phases").isNull(),
        F.concat(F.lit("Suspicious activity on "), F.col("host"), F.lit(" with no clearly profiled behavior.")),
    ).otherwise(F.concat(F.lit("On "), F.col("host"), F.lit(", the activity "), body, F.lit(".")))
    return incidents.select(F.col("id").alias("incident_id"), "host").join(listed, "incident_id", "left").select(
        "incident_id", "phases", summary.alias("summary")
    )


def detection_view(members: DataFrame) -> DataFrame:
    """The stable 13-column detection projection."""
    return members.select(
        "rule_id", "title", "severity", F.coalesce("attack", F.array().cast("array<string>")).alias("attack"), "host",
        "image", "parent_image", "command_line", "process_guid", "incident_id",
        F.coalesce("evidence", F.create_map().cast("map<string,string>")).alias("evidence"),
        forensic_fields(F.col("raw")).alias("forensics"), "matched_at",
    )


def incident_view(incidents: DataFrame) -> DataFrame:
    """The stable incident projection; `status` and `notes` come from `triage_overlay`, with defaults here."""
    none = F.array().cast("array<string>")
    status = F.coalesce("status", F.lit("open")) if "status" in incidents.columns else F.lit("open")
    notes = F.coalesce("notes", F.lit("")) if "notes" in incidents.columns else F.lit("")
    return incidents.select(
        "id", "title", "host", "root_guid", "severity", "score", "detection_count", F.coalesce("chain", none).alias("chain"),
        F.coalesce("techniques", none).alias("techniques"), "classification", F.coalesce("actionable", F.lit(False)).alias("actionable"),
        status.alias("status"), notes.alias("notes"), "first_seen", "last_seen",
    )


def incident_report_rows(incidents: DataFrame, members: DataFrame, profile: DataFrame) -> DataFrame:
    """Report content as rows (incident_id, section, position, label, content).

    Sections: summary pairs, behaviour phases, then one timeline row per
    detection, whose position sorts by time and arrival.
    """
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss 'UTC'")
    joined = lambda c, sep, empty: F.coalesce(present(F.array_join(c, sep)), F.lit(empty))
    pairs = [
        ("Host", F.col("host")),
        ("Severity", F.concat(F.col("severity"), F.lit(" (score "), F.col("score").cast("string"), F.lit(")"))),
        ("Detections", F.col("detection_count").cast("string")), ("First seen", at("first_seen")),
        ("Last seen", at("last_seen")), ("Process chain", joined("chain", " -> ", "unknown")),
        ("Techniques", joined("techniques", ", ", "none")),
    ]
    item = lambda i, label, content: F.struct(
        F.lpad(F.lit(str(i)), 2, "0").alias("position"), F.lit(label).alias("label"), content.alias("content"))
    summary = incidents.select(
        F.col("id").alias("incident_id"), F.lit("summary").alias("section"),
        F.inline(F.array(*[item(i, label, content) for i, (label, content) in enumerate(pairs)])),
    )
    behaviour = profile.filter("phases IS NOT NULL").select("incident_id", F.explode("phases").alias("p")).select(
        "incident_id", F.lit("behavior").alias("section"), F.lpad(F.col("p.position").cast("string"), 2, "0").alias("position"),
        F.upper("p.tactic").alias("label"), F.col("p.phrase").alias("content"),
    )
    detail = F.to_json(F.struct(
        F.date_format("matched_at", "HH:mm:ss").alias("time"), F.lower("severity").alias("severity"),
        F.coalesce(basename(F.col("image")), F.lit("unknown")).alias("process"), "title", "command_line",
        forensic_fields(F.col("raw")).alias("forensics"), "evidence",
    ))
    timeline = members.select(
        "incident_id", F.lit("timeline").alias("section"),
        F.concat_ws("-", F.lpad(F.col("us").cast("string"), 17, "0"), F.lpad(F.col("seq").cast("string"), 19, "0"),
                    F.col("source").cast("string"), "rule_id").alias("position"),
        F.col("rule_id").alias("label"), detail.alias("content"),
    )
    return summary.unionByName(behaviour).unionByName(timeline)
