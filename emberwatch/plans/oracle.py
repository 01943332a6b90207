"""DuckDB SQL building blocks for checking the registered queries."""

from __future__ import annotations

import re

from emberwatch import model as m
from emberwatch.operators import evidence
from emberwatch.functions.predicates import as_values
from emberwatch.plans import telemetry as tel
from emberwatch.rules.catalogue import RULES


def q(text: str) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"({items(values)})[({index}) % {len(values)} + 1]"


# Field name -> column of `tele`; a payload key the projection never sets is null.
FIELDS = {
    "image": "image", "parent_image": "parent_image", "command_line": "cmd", "host": "host", "user": "usr", "User": "usr",
    "IntegrityLevel": "integrity", "DestinationPort": "dest_port", "DestinationIp": "dest_ip", "TargetImage": "target_image",
    "GrantedAccess": "granted", "TargetObject": "target_object", "Hashes": "hashes",
}


def regex_test(column: str, pattern: str) -> str:
    """Search test in RE2 syntax: look-aheads that start the pattern become separate tests."""
    depth, parts, start = 0, [], 0
    bare = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", lambda x: "_" * len(x.group()), pattern)
    for i, ch in enumerate(bare):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
    parts.append(pattern[start:])
    tests = []
    for part in parts:
        if part.startswith("(?=.*"):
            inner = re.split(r"\)\(\?=\.\*", part[len("(?=.*"):-1])
            tests.append("(" + " AND ".join(f"regexp_matches({column}, {q(p)}, 'i')" for p in inner) + ")")
        else:
            plain = part.replace(r"(?<!\S)", r"(^|\s)").replace(r"(?!\S)", r"(\s|$)").replace(r"(?![\\/])\S+", r"[^\\/\s]\S*")
            tests.append(f"regexp_matches({column}, {q(plain)}, 'i')")
    return " OR ".join(tests)


def field_sql(spec: str, expected) -> str:
    name, *mods = spec.split("|")
    column = FIELDS.get(name, "NULL::VARCHAR")
    op = next((x for x in mods if x != "not"), "equals")
    build = {
        "equals": lambda v: f"lower({column}) = {q(v.lower())}", "contains": lambda v: f"contains(lower({column}), {q(v.lower())})",
        "startswith": lambda v: f"starts_with(lower({column}), {q(v.lower())})",
        "endswith": lambda v: f"suffix(lower({column}), {q(v.lower())})", "re": lambda v: regex_test(column, v),
    }[op]
    test = "coalesce(" + " OR ".join(build(v) for v in as_values(expected)) + ", false)"
    return f"NOT {test}" if "not" in mods else test


def rule_sql(rule) -> str:
    rid, code, _, condition, _, _, detection = rule
    glue = " AND " if condition == "all" else " OR "
    return f"CASE WHEN code = {code} AND (" + glue.join(field_sql(s, v) for s, v in detection.items()) + f") THEN {q(rid)} END"


def case(pairs, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in pairs) + f" ELSE {default} END"


def has_any(column: str, values) -> str:
    return f"list_has_any({column}, {items(values)})"


def chain_cases(field: int) -> str:
    return case([
        (" AND ".join(f"len(list_intersect(rule_ids, {items(ids)})) >= {n}" for n, ids in needs), q((name, title)[field]))
        for name, title, needs in m.CHAINS
    ])


def title_sql() -> str:
    story = case([(f"list_has_all(tactics, {items(need)})", q(title)) for need, title in m.NARRATIVES])
    signature = case([(f"list_contains(rule_ids, {q(r)})", q(title)) for r, title in m.SIGNATURE_TITLES])
    label = case([(f"list_min(tactics) = {q(t)}", q(label)) for t, label in m.TACTIC_LABELS.items()])
    return f"coalesce({chain_cases(1)}, {story}, {signature}, {label}, 'Suspicious activity') || ' on ' || host"


def tactic_values(table) -> str:
    return ", ".join(f"({q(t)}, {q(tactic)})" for tactic, ids in table.items() for t in ids)


def phrase_sql() -> str:
    def occurs(rules, techniques):
        tests = ([has_any("rule_ids", rules)] if rules else []) + ([has_any("techniques", techniques)] if techniques else [])
        return " OR ".join(tests) or "true"

    details = "[" + ", ".join(f"CASE WHEN {occurs(r, t)} THEN {q(x)} END" for r, t, x in evidence.EVASION_DETAILS) + "]"
    details = f"[d for d in {details} if d IS NOT NULL]"
    rows = [("tactic = 'defense-evasion'",
             f"CASE WHEN len({details}) > 0 THEN 'evaded defenses (' || array_to_string({details}, ', ') || ')' ELSE 'took steps to evade defenses' END")]
    measured = {"discovery": "'performed host reconnaissance across ' || breadth || ' distinct techniques'",
                "command-and-control": "'established C2, beaconing to a remote host every ~' || round_even(beat, 0)::BIGINT || 's'"}
    for tactic, options in evidence.PHRASES.items():
        rows.append((f"tactic = {q(tactic)}", f"coalesce({measured.get(tactic, 'NULL')}, " + case([(occurs(r, t), q(x)) for r, t, x in options]) + ")"))
    return case(rows)


def severity_case(column: str) -> str:
    return case([(f"{column} >= {floor}", q(name)) for floor, name in m.SCORE_BANDS], "'info'")


ORD = "us, seq, source, rule_id"
WEIGHT = case([(f"severity = {q(k)}", str(v)) for k, v in m.SEVERITY_WEIGHT.items()])
BASE = r"regexp_replace({}, '^.*[\\/]', '')"
EXCLUDED = ", ".join(q(x) for x in m.EXCLUDED_IMAGES)


def cooldown_cte(candidates: str, keys: str, cooldown_us: int) -> str:
    """Greedy cooldown: from each kept time, the first candidate late enough."""
    on = " AND ".join(f"c.{k} = g.{k}" for k in keys.split(", "))
    return f"""SELECT {keys}, min(us) AS us FROM {candidates} GROUP BY {keys}
  UNION ALL
  SELECT * FROM (SELECT {", ".join("g." + k for k in keys.split(", "))},
      (SELECT min(c.us) FROM {candidates} c WHERE {on} AND c.us >= g.us + {cooldown_us}) AS us FROM {{self}} g) WHERE us IS NOT NULL"""


_seen_rules = [r for r in RULES if r[1] in (1, 3, 10, 13)]
CTES = {
    "tele": f"""SELECT *, CASE WHEN slot > 0 THEN 'p' || (grp * 7 + (slot - 1) // 2) END AS parent, 'p' || (grp * 7 + slot) AS guid FROM (
      SELECT *, CASE WHEN code <> 1 AND pos > 0 THEN (pos - 1) // 2 ELSE pos END AS slot,
        CASE WHEN code = 1 THEN {pick(tel.COMMANDS, 'k')} END AS cmd,
        CASE WHEN code = 1 THEN 'SHA256=' || sha256(k::VARCHAR) || ',MD5=0' END AS hashes,
        CASE WHEN code = 3 THEN '45.132.0.' || (user_id % 10) END AS dest_ip, CASE WHEN code = 3 THEN {pick(tel.PORTS, 'k')} END AS dest_port,
        CASE WHEN code = 10 THEN 'C:\\Windows\\System32\\lsass.exe' END AS target_image,
        CASE WHEN code = 10 THEN {pick(tel.ACCESS, 'k // 2')} END AS granted, CASE WHEN code = 13 THEN {pick(tel.KEYS, 'k // 2')} END AS target_object
      FROM (SELECT event_id AS seq, epoch_us(ts) AS us, user_id, k, event_id // 7 AS grp, event_id % 7 AS pos,
          'H' || (event_id // 7 % {tel.HOSTS}) AS host, 'u' || user_id AS usr, {pick(tel.IMAGES, 'user_id')} AS image,
          CASE WHEN event_id % 7 > 0 THEN {pick(tel.IMAGES, 'user_id + 2')} END AS parent_image, {pick(tel.LEVELS, 'event_id')} AS integrity,
          CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type IN ('signup', 'purchase') THEN 3 WHEN k % 2 = 0 THEN 10 ELSE 13 END AS code
        FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)))""",
    "rules": "SELECT * FROM (VALUES " + ", ".join(
        f"({q(r[0])}, {r[1]}, {q(r[5])}, {q(r[2])}, {items(r[4])})" for r in RULES) + ") AS v(rule_id, event_id, title, severity, attack)",
    "fired": "SELECT seq, unnest([r for r in [" + ",\n".join(rule_sql(r) for r in _seen_rules) + "] if r IS NOT NULL]) AS rule_id FROM tele",
    # Detections: what rules and detectors found, with the event they stand on; beat, breadth and evidence size of the latter.
    "rdet": "SELECT t.*, r.rule_id, r.title, r.severity, r.attack, 0 AS source, NULL::DOUBLE AS beat, NULL::BIGINT AS breadth, 0 AS ev FROM fired f JOIN tele t USING (seq) JOIN rules r USING (rule_id)",
    "beacon_found": f"""SELECT t.*, {q(m.BEACON_RULE)} AS rule_id, 'Periodic outbound connection: ' || a.process || ' to ' || a.dest_ip || ':' || a.dest_port || ' every ~' || round_even(a.med / 1e6, 0)::BIGINT || 's' AS title,
        CASE WHEN a.regularity >= 0.92 THEN 'critical' ELSE 'high' END AS severity, {items(m.BEACON_TECHNIQUES)} AS attack, 1 AS source, printf('%.1f', a.med / 1e6)::DOUBLE AS beat, NULL::BIGINT AS breadth, 6 AS ev
        FROM beacon_alerts a JOIN tele t ON t.seq = a.seq""",
    "disc_found": f"""SELECT t.* REPLACE (NULL::VARCHAR AS cmd), {q(m.DISCOVERY_RULE)} AS rule_id, 'Reconnaissance burst: ' || len(a.attack) || ' distinct discovery techniques in ' || a.span || 's' AS title,
        CASE WHEN a.kinds >= 5 THEN 'high' ELSE 'medium' END AS severity, a.attack, 2 AS source, NULL::DOUBLE AS beat, a.kinds AS breadth, 4 AS ev FROM (SELECT a.seq, a.kinds, list_sort(list(DISTINCT s.technique)) AS attack,
        round_even((max(s.us) - min(s.start_us)) / 1e6, 0)::BIGINT AS span FROM disc_alerts a JOIN disc_sess s ON s.host = a.host AND s.root = a.root AND s.us >= a.us - 1800000000
        AND (s.us < a.us OR (s.us = a.us AND s.seq <= a.seq)) GROUP BY a.seq, a.kinds) a JOIN tele t ON t.seq = a.seq""",
    "scan_found": f"""SELECT t.*, {q(m.SCAN_RULE)} AS rule_id, 'Network ' || CASE WHEN ips >= 2 AND ports >= 3 THEN 'network scan' WHEN ips >= 2 THEN 'host sweep' ELSE 'port scan' END || ': ' || a.process || ' reached ' || ips || ' distinct host(s) and '
        || ports || ' distinct port(s) in ' || round_even(span / 1e6, 0)::BIGINT || 's' AS title, CASE WHEN ips >= 4 OR ports >= 6 THEN 'critical' ELSE 'high' END AS severity,
        CASE WHEN ips >= 2 THEN {items((m.SCAN_TECHNIQUE, m.SWEEP_TECHNIQUE))} ELSE {items((m.SCAN_TECHNIQUE,))} END AS attack, 3 AS source, NULL::DOUBLE AS beat, NULL::BIGINT AS breadth, 6 AS ev
        FROM scan_alerts a JOIN tele t ON t.seq = a.seq""",
    "det": "SELECT * FROM rdet UNION ALL SELECT * FROM beacon_found UNION ALL SELECT * FROM disc_found UNION ALL SELECT * FROM scan_found",
    "nodes": f"""SELECT host, guid, arg_min(parent, seq) AS parent, arg_min(image, seq) AS image, arg_min(cmd, seq) AS cmd,
        arg_min(us, seq) AS first_us, max(us) AS last_us, {BASE.format('arg_min(image, seq)')} AS name FROM tele GROUP BY host, guid""",
    "anc": """SELECT host, guid, guid AS cur, 0 AS depth FROM nodes
        UNION ALL SELECT a.host, a.guid, n.parent, a.depth + 1 FROM anc a JOIN nodes n ON n.host = a.host AND n.guid = a.cur
        JOIN nodes p ON p.host = a.host AND p.guid = n.parent WHERE a.depth < 23""",
    "top": """SELECT a.host, a.guid, arg_max(a.cur, a.depth) AS root, max(a.depth) AS depth, list(n.name ORDER BY a.depth DESC) AS chain,
        list(a.cur ORDER BY a.depth DESC) AS path, arg_max(n.image, a.depth) AS root_image FROM anc a JOIN nodes n ON n.host = a.host AND n.guid = a.cur GROUP BY a.host, a.guid""",
    "rooted": "SELECT d.*, t.root, t.chain, t.root_image FROM det d JOIN top t ON t.host = d.host AND t.guid = d.guid",
    "gapped": f"""SELECT *, sum(CASE WHEN prev IS NULL OR us - prev > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY host, root ORDER BY {ORD}) AS sess
        FROM (SELECT *, lag(us) OVER (PARTITION BY host, root ORDER BY {ORD}) AS prev FROM rooted)""",
    "members": "SELECT *, host || '/' || root || '/' || min(us) OVER (PARTITION BY host, root, sess) AS incident_id FROM gapped",
    "inc0": f"""SELECT incident_id AS id, host, root, list(root_image ORDER BY {ORD})[1] AS root_image, sum({WEIGHT})::BIGINT AS score, count(*) AS detection_count,
        bool_or(severity = 'critical') AS critical, list(chain ORDER BY len(chain) DESC, {ORD})[1] AS chain, list_sort(list(DISTINCT rule_id)) AS rule_ids,
        list_sort(list_distinct(flatten(list(attack)))) AS techniques, min(us) AS first_us, max(us) AS last_us FROM members GROUP BY incident_id, host, root""",
    "tactic_of": "SELECT * FROM (VALUES " + tactic_values(m.TITLE_TACTICS) + ") AS v(technique, tactic)",
    "inc_tactics": """SELECT i.id, [x for x in list_sort(list_distinct(list(coalesce(a.tactic, b.tactic)))) if x IS NOT NULL] AS tactics FROM (SELECT id, unnest(techniques) AS technique FROM inc0) i
        LEFT JOIN tactic_of a ON a.technique = i.technique LEFT JOIN tactic_of b ON b.technique = split_part(i.technique, '.', 1) GROUP BY i.id""",
    "inc": f"""SELECT i.*, t.tactics, {severity_case('score')} AS severity, (score >= 12 OR critical OR detection_count >= 3) AS actionable,
        {chain_cases(0)} AS classification, {title_sql()} AS title FROM inc0 i LEFT JOIN inc_tactics t USING (id)""",
    "conn": f"""SELECT *, lower({BASE.format('image')}) AS process FROM tele WHERE code = 3 AND lower({BASE.format('image')}) NOT IN ({EXCLUDED})""",
    # Beacon: frames of 64 connections per channel.
    "beacon_frames": """SELECT *, list(us) OVER (PARTITION BY host, process, dest_ip, dest_port ORDER BY us, seq ROWS 63 PRECEDING) AS frame FROM conn""",
    "beacon_gaps": "SELECT *, list_sort([frame[i + 1] - frame[i] for i in range(1, len(frame))]) AS gaps FROM beacon_frames",
    "beacon_med": """SELECT *, (gaps[(len(gaps) - 1) // 2 + 1] + gaps[len(gaps) // 2 + 1]) / 2.0 AS med FROM beacon_gaps WHERE len(frame) >= 6""",
    "beacon_dev": """SELECT *, list_sort([abs(g - med) for g in gaps]) AS devs, frame[-1] - frame[1] AS span FROM beacon_med
        WHERE med BETWEEN 5e6 AND 864e9 AND frame[-1] - frame[1] >= med * 5 AND gaps[-1] <= med * 6""",
    "beacon_cand": """SELECT * FROM (SELECT *, greatest(least(1 - ((devs[(len(devs) - 1) // 2 + 1] + devs[len(devs) // 2 + 1]) / 2.0) / med, 1.0), 0.0) AS regularity FROM beacon_dev) WHERE regularity >= 0.3""",
    "beacon_kept": cooldown_cte("beacon_cand", "host, process, dest_ip, dest_port", 86_400_000_000).format(self="beacon_kept"),
    "beacon_alerts": """SELECT c.* FROM beacon_cand c JOIN beacon_kept USING (host, process, dest_ip, dest_port, us)
        QUALIFY row_number() OVER (PARTITION BY host, process, dest_ip, dest_port, us ORDER BY seq) = 1""",
    # Discovery: recon kinds per tree within 30 minutes.
    "recon": "SELECT * FROM (SELECT t.*, top.root, " + case(
        [(f"regexp_matches(cmd, {q(p)}, 'i')", q(tech)) for tech, _, p in m.DISCOVERY_SIGNATURES]) +
        " AS technique FROM tele t JOIN top USING (host, guid) WHERE code = 1) WHERE technique IS NOT NULL",
    "disc_cand": """SELECT r.host, r.root, r.us, r.seq, count(DISTINCT w.technique) AS kinds FROM recon r JOIN recon w ON w.host = r.host AND w.root = r.root
        AND w.us >= r.us - 1800000000 AND (w.us < r.us OR (w.us = r.us AND w.seq <= r.seq)) GROUP BY r.host, r.root, r.us, r.seq HAVING count(DISTINCT w.technique) >= 2""",
    "disc_kept": cooldown_cte("disc_cand", "host, root", 600_000_000).format(self="disc_kept"),
    "disc_alerts": """SELECT c.* FROM disc_cand c JOIN disc_kept USING (host, root, us) QUALIFY row_number() OVER (PARTITION BY host, root, us ORDER BY seq) = 1""",
    "disc_sess": """SELECT *, min(us) OVER (PARTITION BY host, root, technique, s) AS start_us FROM (SELECT *, sum(CASE WHEN prev IS NULL OR us - prev > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY host, root, technique ORDER BY us, seq) AS s
        FROM (SELECT *, lag(us) OVER (PARTITION BY host, root, technique ORDER BY us, seq) AS prev FROM recon))""",
    # Scan: distinct destinations per process within 30 minutes.
    "scan_win": """SELECT r.host, r.process, r.guid, r.us, r.seq, w.dest_ip, w.dest_port, w.us AS wus FROM conn r JOIN conn w ON w.host = r.host AND w.process = r.process AND w.guid = r.guid
        AND w.us >= r.us - 1800000000 AND (w.us < r.us OR (w.us = r.us AND w.seq <= r.seq))""",
    "scan_pairs": "SELECT host, process, guid, us, seq, dest_ip, dest_port, max(wus) AS last_us FROM scan_win GROUP BY ALL",
    "scan_cand": """SELECT host, process, guid, us, seq, count(DISTINCT dest_ip) AS ips, count(DISTINCT dest_port) AS ports, count(*) AS pairs, max(last_us) - min(last_us) AS span,
        list_sort(list(dest_ip || ':' || dest_port))[:10] AS sample FROM scan_pairs GROUP BY host, process, guid, us, seq HAVING count(DISTINCT dest_ip) >= 2 OR count(DISTINCT dest_port) >= 3""",
    "scan_kept": cooldown_cte("scan_cand", "host, process, guid", 3_600_000_000).format(self="scan_kept"),
    "scan_alerts": """SELECT c.* FROM scan_cand c JOIN scan_kept USING (host, process, guid, us) QUALIFY row_number() OVER (PARTITION BY host, process, guid, us ORDER BY seq) = 1""",
    # Technique catalogue derived from `part`.
    "catalogue": """SELECT 'T' || (p_partkey + 1000) AS id, p_name AS name, p_type AS description, [lower(p_type)] AS tactics, 'https://t/T' || (p_partkey + 1000) AS url
        FROM part WHERE p_size % 7 <> 0 AND p_size % 13 <> 0 AND p_size % 17 <> 0 AND p_size % 11 <> 0""",
    "raised": f"SELECT id, count(*) AS rule_count FROM (SELECT unnest(attack) AS id FROM rules UNION ALL SELECT unnest({items(m.DETECTOR_TECHNIQUES)})) GROUP BY id",
    "covered": "SELECT coalesce(c.id, r.id) AS id, coalesce(c.name, '') AS name, coalesce(c.tactics, []) AS tactics, coalesce(r.rule_count, 0) AS rule_count FROM catalogue c FULL JOIN raised r ON r.id = c.id",
    # Analyst triage: log rows come from detections.
    "triage_log": """SELECT incident_id, us AS changed_us, seq, (['closed', 'false_positive', 'OPEN', 'bogus'])[seq // 2 % 4 + 1] AS status,
        CASE WHEN seq % 35 = 0 THEN repeat('word ', 501) WHEN seq % 3 = 0 THEN 'note ' || seq END AS notes FROM members WHERE seq % 2 = 0""",
    "triage": """SELECT i.*, coalesce(t.status, 'open') AS status, coalesce(t.notes, '') AS notes FROM inc i LEFT JOIN (
        SELECT incident_id, list(lower(status) ORDER BY changed_us DESC, seq DESC) FILTER (lower(status) IN ('open', 'closed', 'false_positive'))[1] AS status,
          list(notes ORDER BY changed_us DESC, seq DESC) FILTER (notes NOT LIKE 'word%')[1] AS notes FROM triage_log GROUP BY incident_id) t ON t.incident_id = i.id""",
    "phase_of": "SELECT * FROM (VALUES " + tactic_values(m.NARRATIVE_TACTICS) + ") AS v(technique, tactic)",
    "member_phase": """SELECT DISTINCT x.incident_id, x.us, x.seq, x.source, x.rule_id, x.attack, x.beat, x.breadth, coalesce(a.tactic, b.tactic) AS tactic FROM (SELECT *, unnest(attack) AS t FROM members) x
        LEFT JOIN phase_of a ON a.technique = x.t LEFT JOIN phase_of b ON b.technique = split_part(x.t, '.', 1)""",
    "phase0": f"""SELECT incident_id, tactic, list(breadth ORDER BY {ORD}) FILTER (breadth > 0)[1] AS breadth, list(beat ORDER BY {ORD}) FILTER (beat > 0)[1] AS beat, list_sort(list(DISTINCT rule_id)) AS rule_ids, list_distinct(flatten(list(attack))) AS techniques FROM member_phase WHERE tactic IS NOT NULL GROUP BY incident_id, tactic""",
    "phase_exact": """SELECT x.incident_id, x.tactic, list_sort(list(x.t)) AS exact FROM (SELECT incident_id, tactic, unnest(techniques) AS t FROM phase0) x
        JOIN phase_of o ON o.technique = x.t AND o.tactic = x.tactic GROUP BY x.incident_id, x.tactic""",
    "phases": f"""SELECT p.incident_id, list_position({items(m.PHASE_ORDER)}, p.tactic) AS position, p.tactic, {phrase_sql().replace('tactic =', 'p.tactic =')} AS phrase, rule_ids,
        coalesce(e.exact, []) AS exact FROM phase0 p LEFT JOIN phase_exact e USING (incident_id, tactic) WHERE list_position({items(m.PHASE_ORDER)}, p.tactic) > 0""",
}


def sql(body: str, **extra: str) -> str:
    """`body` with the building blocks it names, directly or through another, in front.

    `extra` adds blocks for this query alone; they may name shared ones.
    """
    blocks = {**CTES, **extra}
    parts: dict[str, str] = {}

    def place(text: str, within: tuple[str, ...] = ()) -> None:
        """What a text names goes before it; a recursive block names itself."""
        for name in blocks:
            if name not in parts and name not in within and re.search(rf"\b{name}\b", text):
                place(blocks[name], (*within, name))
                parts[name] = f"{name} AS ({blocks[name]})"

    place(body)
    return ("WITH RECURSIVE " + ",\n".join(parts.values()) + "\n" if parts else "") + body
