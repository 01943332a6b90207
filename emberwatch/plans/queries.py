"""Registered queries: each operator over the driver's tables, with its check in SQL beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from emberwatch import model as m
from emberwatch.functions import predicates as pr, scalars as sc
from emberwatch.operators import (
    coverage, detectors, evidence, exports, incidents as inc, matching, normalize, ordering, search, similarity, stats, tree,
)
from emberwatch.plans import oracle as o, telemetry as tel
from emberwatch.plans.detection import Detection
from emberwatch.session import checkpointed, load_table, scratch_path
from emberwatch.sources import catalogue as cat, events as src, tables
from emberwatch.streaming import detectors as live, flow, forest
from emberwatch.streaming.incidents import stream_incidents

DAY_S = 86_400
# Thresholds that fit the driver's sparse synthetic events; the operators' own defaults suit real telemetry.
BEACON = {"max_interval_s": 864_000.0, "max_interval_ratio": 6.0, "min_regularity": 0.3, "cooldown_s": DAY_S}
DISCOVERY = {"min_distinct": 2, "window_s": 1800, "cooldown_s": 600}
SCAN = {"min_ips": 2, "min_ports": 3, "window_s": 1800, "cooldown_s": 3600}
CHANNEL = detectors.CHANNEL

REGISTRY: dict[str, tuple[Callable[["Data"], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, **blocks: str):
    def register(fn):
        REGISTRY[name] = (fn, o.sql(sql, **blocks) if sql else None)
        return fn
    return register


def us(c: str):
    return m.epoch_us(F.col(c))


def joined(c: str, sep: str = ","):
    return F.array_join(F.col(c), sep)


class Data:
    """The tables of one folder and what the queries derive from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return load_table(self.spark, self.sf_dir, name)

    @cached_property
    def events(self) -> DataFrame:
        return tel.telemetry(self.spark, self.sf_dir)

    @cached_property
    def plan(self) -> Detection:
        return Detection(self.events, settings={"beacon": BEACON, "discovery": DISCOVERY, "scan": SCAN})

    @cached_property
    def conns(self) -> DataFrame:
        return detectors.connections(self.events)

    @cached_property
    def recon(self) -> DataFrame:
        return detectors.recon_commands(self.events, self.plan.roots)

    @cached_property
    def catalogue(self) -> DataFrame:
        return cat.catalogue_from_objects(tel.stix_source(self.spark, self.sf_dir))

    @cached_property
    def rules(self) -> DataFrame:
        return matching.rules_frame(self.spark, self.plan.rules)

    @cached_property
    def triage_log(self) -> DataFrame:
        seq = F.col("seq")
        return self.plan.members.filter(seq % 2 == 0).select(
            "incident_id", F.col("us").alias("changed_at"), "seq",
            F.element_at(F.lit(["closed", "false_positive", "OPEN", "bogus"]), F.expr("int(seq div 2 % 4 + 1)")).alias("status"),
            F.when(seq % 35 == 0, F.repeat(F.lit("word "), 501)).when(seq % 3 == 0, F.concat(F.lit("note "), seq.cast("string"))).alias("notes"),
        )

    @cached_property
    def triaged(self) -> DataFrame:
        return tables.triage_overlay(self.plan.incidents, self.triage_log)

    def scratch(self) -> str:
        return scratch_path(self.spark, "scratch")


# -- 2.1 sources and sinks -------------------------------------------------------

@query("read_events_jsonl", "SELECT seq % 25 <> 4 AS is_valid, count(*) AS lines FROM tele GROUP BY 1")
def _(d):
    path = d.scratch()
    tel.payloads(d.events).select("value").write.text(path)
    return src.read_events_jsonl(d.spark, path).groupBy("is_valid").agg(F.count("*").alias("lines"))


@query("replay_filter", """SELECT seq, code AS event_id FROM tele WHERE seq % 9 <> 0 AND code IN (1, 3) ORDER BY seq LIMIT 500""")
def _(d):
    rows = d.events.select("seq", "event_id", F.when(F.col("seq") % 9 == 0, "Security").when(F.col("seq") % 9 != 1, m.SYSMON_CHANNEL).alias("channel"))
    return src.replay_filter(rows, event_ids=[1, 3], limit=500).select("seq", "event_id")


@query("lift_text_nodes", "SELECT seq, image, code AS event_id FROM tele")
def _(d):
    lifted = tel.evtx_records(d.events).withColumn("v", src.lift_text_nodes(F.col("value")))
    get = lambda path: F.get_json_object("v", path)
    return lifted.select("seq", get("$.Event.EventData.Image").alias("image"), F.get_json_object(get("$.Event.System.EventID"), "$['#text']").cast("int").alias("event_id"))


@query("evtx_json_to_payload", """SELECT seq, CASE WHEN seq % 9 = 0 THEN 'Security' WHEN seq % 9 <> 1 THEN 'Microsoft-Windows-Sysmon/Operational' ELSE '' END AS channel,
    code AS event_id, host, image, us FROM tele""")
def _(d):
    out = src.evtx_json_to_payload(tel.evtx_records(d.events))
    events = normalize.normalize_events(out.withColumn("received_at", F.lit(None).cast("timestamp")))
    return events.select("seq", "event_id", "host", "image", us("timestamp").alias("us")).join(out.select("seq", "channel"), "seq")


OUTCOME = "CASE WHEN seq % 25 IN (4, 9, 14) THEN 'malformed' WHEN seq % 25 = 19 THEN 'oversize' ELSE 'accepted' END"


@query("intake_split", f"SELECT {OUTCOME} AS outcome, count(*) AS payloads FROM tele GROUP BY 1")
def _(d):
    return src.intake_counts(src.intake_split(tel.payloads(d.events), max_bytes=2000))


@query("detections_sink", f"SELECT rule_id, strftime(make_timestamp(us), '%Y-%m-%d') AS day, count(*) AS detections FROM det GROUP BY 1, 2")
def _(d):
    path = d.scratch()
    tables.detections_sink(d.plan.detections, path)
    return d.spark.read.parquet(path).groupBy("rule_id", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("detections"))


@query("incidents_upsert", """SELECT id, CASE WHEN score >= 12 THEN 1000 + score ELSE score END AS score, CASE WHEN score < 20 THEN first_us ELSE first_us + 60000000 END AS first_us FROM inc""")
def _(d):
    # The table holds incidents below 20; an update raises those from 12 up and adds the rest.
    base = d.plan.incidents.select("id", F.col("score").cast("bigint").alias("score"), "first_seen")
    changed = base.filter("score >= 12").select("id", (F.col("score") + 1000).alias("score"), (F.col("first_seen") + F.expr("INTERVAL 1 MINUTE")).alias("first_seen"))
    return tables.incidents_upsert(base.filter("score < 20"), changed).select("id", "score", us("first_seen").alias("first_us"))


@query("triage_overlay", "SELECT id, status, notes FROM triage")
def _(d):
    return d.triaged.select("id", "status", "notes")


@query("triage_refused", """SELECT incident_id, seq, concat_ws(',', CASE WHEN status = 'bogus' THEN 'status' END, CASE WHEN seq % 35 = 0 THEN 'notes' END) AS refused
    FROM triage_log WHERE status = 'bogus' OR seq % 35 = 0""")
def _(d):
    return tables.triage_refused(d.triage_log).select("incident_id", "seq", joined("refused").alias("refused"))


@query("attack_catalogue", "SELECT id, name, description, tactics[1] AS tactic, len(tactics) AS tactic_count, url FROM catalogue")
def _(d):
    return d.catalogue.select("id", "name", "description", F.get("tactics", F.lit(0)).alias("tactic"), F.size("tactics").cast("bigint").alias("tactic_count"), "url")


@query("catalogue_missing", "SELECT id FROM raised WHERE id NOT IN (SELECT id FROM catalogue)")
def _(d):
    return cat.catalogue_missing(coverage.rule_counts_by_technique(d.rules).select("id"), d.catalogue)


@query("detections_for_incident", """SELECT m.incident_id, m.us, m.rule_id FROM members m WHERE m.incident_id = (SELECT incident_id FROM members GROUP BY incident_id ORDER BY count(*) DESC, incident_id LIMIT 1)""")
def _(d):
    members = d.plan.members
    largest = members.groupBy("incident_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "incident_id").first()
    return inc.detections_for_incident(members, largest["incident_id"]).select("incident_id", "us", "rule_id")


@query("rules_per_event_id", "SELECT code AS event_id, count(DISTINCT t.seq) AS events, any_value(r.rules) AS rules FROM tele t JOIN (SELECT event_id, count(*) AS rules FROM rules GROUP BY 1) r ON r.event_id = t.code GROUP BY 1")
def _(d):
    seen = d.events.groupBy("event_id").agg(F.count("*").alias("events"))
    return seen.join(matching.rules_per_event_id(d.rules), "event_id")


# -- 2.2 projections ----------------------------------------------------------------

ACCEPTED = "seq % 25 NOT IN (4, 9, 14, 19)"


@query("normalize_events", f"""SELECT seq, CASE WHEN seq % 5 < 3 THEN code ELSE 0 END AS event_id,
    CASE WHEN seq % 5 < 3 THEN us ELSE us + 3600000000 END AS us, CASE WHEN seq % 5 = 4 THEN 'unknown' ELSE host END AS host,
    CASE WHEN seq % 5 < 3 THEN image WHEN seq % 5 = 3 THEN 'src.exe' END AS image, CASE WHEN seq % 5 < 4 THEN cmd END AS command_line,
    CASE WHEN seq % 5 < 3 THEN guid WHEN seq % 5 = 3 THEN 's' || guid END AS process_guid, CASE WHEN seq % 5 < 4 THEN parent END AS parent_process_guid,
    coalesce(CASE WHEN seq % 5 < 3 THEN seq % 65536 END, -1) AS pid FROM tele WHERE {ACCEPTED}""")
def _(d):
    good = src.intake_split(tel.payloads(d.events), max_bytes=2000).filter("outcome = 'accepted'")
    return normalize.normalize_events(good).select(
        "seq", "event_id", us("timestamp").alias("us"), "host", "image", "command_line", "process_guid", "parent_process_guid",
        F.coalesce("process_id", F.lit(-1)).cast("bigint").alias("pid"))


@query("promote_fields", "SELECT seq, CASE seq % 5 WHEN 0 THEN image WHEN 3 THEN 'src.exe' END AS image, CASE seq % 5 WHEN 0 THEN guid WHEN 3 THEN 's' || guid END AS process_guid, CASE WHEN seq % 5 IN (0, 3) THEN usr END AS user_name FROM tele")
def _(d):
    data = F.try_variant_get(F.try_parse_json("value"), "$.winlog.event_data", "map<string,string>")
    rows = tel.payloads(d.events).withColumn("data", data)
    got = normalize.promote_fields(F.col("data"))
    return rows.select("seq", got["image"].alias("image"), got["process_guid"].alias("process_guid"), got["user"].alias("user_name"))


@query("parse_event_ts", "SELECT seq, CASE WHEN seq % 4 = 3 THEN us + 3600000000 ELSE us END AS us FROM tele")
def _(d):
    forms = [F.date_format("timestamp", f) for f in ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")]
    text = F.element_at(F.array(*forms, F.lit("garbage")), (F.col("seq") % 4 + 1).cast("int"))
    at = normalize.parse_event_ts(text, F.col("timestamp") + F.expr("INTERVAL 1 HOUR"))
    return d.events.select("seq", m.epoch_us(at).alias("us"))


@query("extract_host", f"SELECT seq, CASE WHEN seq % 5 = 4 THEN 'unknown' ELSE host END AS host FROM tele WHERE {ACCEPTED}")
def _(d):
    v = F.try_parse_json("value")
    rows = src.intake_split(tel.payloads(d.events), max_bytes=2000).filter("outcome = 'accepted'").withColumn("v", v)
    rows = rows.withColumn("w", F.coalesce(F.try_variant_get("v", "$.winlog", "variant"), F.col("v")))
    data = F.coalesce(F.try_variant_get("w", "$.event_data", "map<string,string>"), F.try_variant_get("v", "$", "map<string,string>"))
    return rows.select("seq", normalize.extract_host(F.col("v"), F.col("w"), data).alias("host"))


@query("parse_event_id", "SELECT seq, CASE WHEN seq % 3 = 2 THEN 0 ELSE code END AS event_id FROM tele")
def _(d):
    first = F.when(F.col("seq") % 3 == 0, F.col("event_id").cast("string")).when(F.col("seq") % 3 == 2, "x1")
    return d.events.select("seq", normalize.parse_event_id(first, F.lit("0"), F.col("event_id").cast("string")).alias("event_id"))


@query("resolve_field", "SELECT seq, image, dest_ip, NULL::VARCHAR AS missing FROM tele")
def _(d):
    return d.events.select("seq", pr.resolve_field("image").alias("image"), pr.resolve_field("DestinationIp").alias("dest_ip"), pr.resolve_field("Image").alias("missing"))


@query("basename", f"SELECT seq, {o.BASE.format('image')} AS name, coalesce({o.BASE.format('parent_image')}, 'unknown') AS parent_name FROM tele")
def _(d):
    return d.events.select("seq", sc.basename(F.col("image")).alias("name"), sc.basename(F.col("parent_image"), "unknown").alias("parent_name"))


@query("forensic_fields", """SELECT seq, usr AS user_name, integrity, hashes, dest_ip, target_object,
    2 + (hashes IS NOT NULL)::INT + 2 * (dest_ip IS NOT NULL)::INT + (target_object IS NOT NULL)::INT + 2 * (granted IS NOT NULL)::INT AS fields FROM tele""")
def _(d):
    f = F.col("f")
    return d.events.withColumn("f", sc.forensic_fields(F.col("raw"))).select(
        "seq", f["user"].alias("user_name"), f["integrity_level"].alias("integrity"), f["hashes"].alias("hashes"),
        f["destination_ip"].alias("dest_ip"), f["registry_key"].alias("target_object"), F.size(f).alias("fields"))


@query("detection_view", """SELECT rule_id, title, severity, array_to_string(attack, ',') AS attack, host, image, parent_image, cmd AS command_line, guid AS process_guid,
    incident_id, us, usr AS user_name, ev AS evidence_size FROM members""")
def _(d):
    v = evidence.detection_view(d.plan.members)
    return v.select("rule_id", "title", "severity", joined("attack").alias("attack"), "host", "image", "parent_image", "command_line",
                    "process_guid", "incident_id", us("matched_at").alias("us"), F.col("forensics")["user"].alias("user_name"), F.size("evidence").alias("evidence_size"))


@query("incident_view", """SELECT id, title, host, severity, score, detection_count, array_to_string(chain, '>') AS chain, array_to_string(techniques, ',') AS techniques,
    classification, actionable, status, notes, first_us, last_us FROM triage""")
def _(d):
    return evidence.incident_view(d.triaged).select(
        "id", "title", "host", "severity", F.col("score").cast("bigint").alias("score"), "detection_count", joined("chain", ">").alias("chain"),
        joined("techniques").alias("techniques"), "classification", "actionable", "status", "notes", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"))


@query("incident_process_tree", """SELECT i.id AS incident_id, t.guid, n.parent AS parent_guid, t.depth, n.name, coalesce(m.n, 0) AS detections, m.worst AS worst_severity, n.first_us, n.last_us FROM inc i JOIN top t ON t.host = i.host AND t.root = i.root
    JOIN nodes n ON n.host = t.host AND n.guid = t.guid LEFT JOIN (SELECT incident_id, guid, count(*) AS n, (['info', 'low', 'medium', 'high', 'critical'])[max(list_position(['info', 'low', 'medium', 'high', 'critical'], severity))] AS worst FROM members GROUP BY 1, 2) m ON m.incident_id = i.id AND m.guid = t.guid""")
def _(d):
    rows = tree.incident_process_tree(d.plan.incidents, d.plan.members, d.plan.nodes, d.plan.roots)
    return rows.select("incident_id", "guid", "parent_guid", "depth", "name", "detections", "worst_severity", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"))


# -- 2.3 predicates ---------------------------------------------------------------

def _part_predicate(name: str, build, sql: str):
    @query(name, f"SELECT p_partkey, coalesce({sql}, false) AS hit FROM (SELECT p_partkey, nullif(p_name, 'red widget') AS p_name, p_type, p_brand FROM part)")
    def _(d):
        rows = d.table("part").select("p_partkey", F.nullif(F.col("p_name"), F.lit("red widget")).alias("p_name"), "p_type", "p_brand")
        return rows.select("p_partkey", F.coalesce(build(), F.lit(False)).alias("hit"))


_part_predicate("pred_equals", lambda: pr.pred_equals(F.col("p_type"), ["economy", "Promo"]), "lower(p_type) IN ('economy', 'promo')")
_part_predicate("pred_contains", lambda: pr.pred_contains(F.col("p_name"), ["RED", "ring"]), "contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring')")
_part_predicate("pred_startswith", lambda: pr.pred_startswith(F.col("p_name"), "Small"), "starts_with(lower(p_name), 'small')")
_part_predicate("pred_endswith", lambda: pr.pred_endswith(F.col("p_name"), ["RING", "bolt"]), "suffix(lower(p_name), 'ring') OR suffix(lower(p_name), 'bolt')")
_part_predicate("pred_regex", lambda: pr.pred_regex(F.col("p_brand"), [r"brand#1\d$", r"#2\b"]), r"regexp_matches(p_brand, 'brand#1\d$', 'i') OR regexp_matches(p_brand, '#2\b', 'i')")
_part_predicate("pred_not", lambda: pr.pred_not(pr.pred_contains(F.col("p_name"), "ring")), "NOT coalesce(contains(lower(p_name), 'ring'), false)")
_part_predicate("pred_any_value", lambda: pr.pred_endswith(F.col("p_name"), "ring") | pr.pred_endswith(F.col("p_name"), ["widget"]),
                "suffix(lower(p_name), 'ring') OR suffix(lower(p_name), 'widget')")
_part_predicate("glob_match", lambda: pr.glob_match(F.col("p_name"), "*ed*") | pr.glob_match(F.col("p_name"), ["s?all*", "*ring"]),
                "contains(lower(p_name), 'ed') OR regexp_matches(p_name, '^s.all.*$', 'i') OR suffix(lower(p_name), 'ring')")


def _rule(condition: str, detection: dict) -> matching.Rule:
    return matching.Rule("X", 1, "high", "x", detection, condition=condition)


MIXED = {"image|endswith": [r"\cmd.exe", r"\powershell.exe"], "command_line|re": r"\bnet(stat)?\b", "parent_image|endswith|not": r"\explorer.exe"}


@query("rule_all", "SELECT seq, " + " AND ".join(o.field_sql(s, v) for s, v in MIXED.items()) + " AS fires FROM tele")
def _(d):
    return d.events.select("seq", _rule("all", MIXED).test().alias("fires"))


@query("rule_any", "SELECT seq, " + " OR ".join(o.field_sql(s, v) for s, v in MIXED.items()) + " AS fires FROM tele")
def _(d):
    return d.events.select("seq", _rule("any", MIXED).test().alias("fires"))


@query("match_rules", "SELECT seq, rule_id, title, severity, array_to_string(attack, ',') AS attack, us FROM rdet")
def _(d):
    return matching.match_rules(d.events, d.plan.rules).select("seq", "rule_id", "title", "severity", joined("attack").alias("attack"), us("matched_at").alias("us"))


@query("rule_catalogue", "SELECT rule_id, event_id, severity, len(attack) AS techniques, coalesce(n, 0) AS fires FROM rules LEFT JOIN (SELECT rule_id, count(*) AS n FROM fired GROUP BY rule_id) USING (rule_id)")
def _(d):
    fires = d.plan.detections.groupBy("rule_id").agg(F.count("*").alias("n"))
    return d.rules.join(fires, "rule_id", "left").select("rule_id", "event_id", "severity", F.size("attack").alias("techniques"), F.coalesce("n", F.lit(0)).alias("fires"))


# -- 2.4 joins -----------------------------------------------------------------------

@query("event_rule_join", "SELECT code AS event_id, r.severity, count(*) AS candidates FROM tele t JOIN rules r ON r.event_id = t.code GROUP BY 1, 2")
def _(d):
    return matching.event_rule_join(d.events.select("event_id"), d.rules).groupBy("event_id", "severity").agg(F.count("*").alias("candidates"))


@query("parent_child_join", "SELECT c.host, c.guid AS child_guid, c.parent AS parent_guid, p.name AS parent_name, c.name AS child_name FROM nodes c JOIN nodes p ON p.host = c.host AND p.guid = c.parent")
def _(d):
    return tree.parent_child_join(d.plan.nodes).select("host", "child_guid", "parent_guid", "parent_name", "child_name")


@query("detection_incident_join", "SELECT m.seq, m.rule_id, m.incident_id, i.title AS incident_title, i.severity AS incident_severity FROM members m JOIN inc i ON i.id = m.incident_id")
def _(d):
    return inc.detection_incident_join(d.plan.members, d.plan.incidents).select("seq", "rule_id", "incident_id", "incident_title", "incident_severity")


@query("rule_ids_by_incident", "SELECT id AS incident_id, array_to_string(rule_ids, ',') AS rule_ids FROM inc WHERE actionable")
def _(d):
    wanted = d.plan.incidents.filter("actionable").select(F.col("id").alias("incident_id"))
    return inc.rule_ids_by_incident(d.plan.members, wanted).select("incident_id", joined("rule_ids").alias("rule_ids"))


@query("technique_lookup", """SELECT technique, coalesce(a.name, b.name) AS name, coalesce(a.id, b.id) AS matched, CASE WHEN a.id IS NULL AND b.id IS NOT NULL THEN 'Parent technique of ' || technique END AS note, detections
    FROM (SELECT technique, count(*) AS detections FROM (SELECT unnest(attack) AS technique FROM det) GROUP BY 1) x LEFT JOIN catalogue a ON a.id = technique
    LEFT JOIN catalogue b ON b.id = split_part(technique, '.', 1) AND technique <> split_part(technique, '.', 1)""")
def _(d):
    seen = d.plan.detections.select(F.explode("attack").alias("technique")).groupBy("technique").agg(F.count("*").alias("detections"))
    out = cat.technique_lookup(seen, d.catalogue)
    return out.select("technique", "name", F.substring_index("url", "/", -1).alias("matched"), "note", "detections")


@query("coverage_join", "SELECT id, name, array_to_string(tactics, ',') AS tactics, rule_count FROM covered")
def _(d):
    return coverage.coverage_join(d.catalogue, coverage.rule_counts_by_technique(d.rules)).select("id", "name", joined("tactics").alias("tactics"), "rule_count")


UNION_SIZE = "len(list_distinct(list_concat(a.{0}, b.{0})))"
SHAPE_SQL = "concat_ws(chr(31), root, " + ", ".join(f"coalesce(array_to_string({c}, chr(30)), chr(29))" for c in ("chain", "techniques", "rule_ids")) + ")"
NOISE = {
    "prints": f"SELECT *, sha256({SHAPE_SQL}) AS fp FROM (SELECT id, coalesce(lower(chain[1]), '') AS root, list_sort(list_distinct([lower(c) for c in chain])) AS chain, techniques, rule_ids, last_us, status FROM triage)",
    "open_kinds": "SELECT DISTINCT fp, root, chain, techniques, rule_ids FROM prints WHERE status = 'open'",
    "past_kinds": "SELECT DISTINCT fp, root, chain, techniques, rule_ids FROM prints WHERE status = 'false_positive'",
    # Added in the operator's order and divided by the same sum of weights, so that doubles agree to the bit.
    "scored": "SELECT a.fp, b.fp AS matched_fp, (" + " + ".join(
        f"{w}::DOUBLE * (len(list_intersect(a.{c}, b.{c}))::DOUBLE / {UNION_SIZE.format(c)})" if c else
        f"{w}::DOUBLE * (a.root <> '' AND a.root = b.root)::INT" for w, c in ((0.5, "rule_ids"), (0.2, "techniques"), (0.2, ""), (0.1, "chain"))
    ) + f") / {0.5 + 0.2 + 0.2 + 0.1!r}::DOUBLE AS score FROM open_kinds a, past_kinds b",
    "noisy": "SELECT * FROM scored WHERE score >= 0.6::DOUBLE",
    "ranked": "SELECT n.fp, h.id AS matched_id, printf('%.2f', n.score)::DOUBLE AS score, row_number() OVER (PARTITION BY n.fp ORDER BY printf('%.2f', n.score)::DOUBLE DESC, h.last_us DESC, h.id) AS place FROM noisy n JOIN prints h ON h.fp = n.matched_fp AND h.status = 'false_positive'",
}


def _noise(d, best=None):
    """(open incidents, past false positives, pairs of their shapes)."""
    # Written once: both sides read it, for the pairs and for what is made of them.
    shape = checkpointed(similarity.fingerprints(d.triaged).join(d.triaged.select("id", "status"), "id"))
    open_, past = (shape.filter(F.col("status") == s).drop("status") for s in ("open", "false_positive"))
    return open_, past, similarity.noise_join(open_, past, best=best)


@query("noise_join", "SELECT fp, matched_fp, round(score, 6) AS score FROM noisy", **NOISE)
def _(d):
    return _noise(d)[2].select("fp", "matched_fp", F.round("score", 6).alias("score"))


@query("node_detection_join", """SELECT n.host, n.guid, coalesce(count(d.seq), 0) AS detections, CASE max(list_position(['info', 'low', 'medium', 'high', 'critical'], d.severity))
    WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' WHEN 1 THEN 'info' END AS worst_severity
    FROM nodes n LEFT JOIN det d ON d.host = n.host AND d.guid = n.guid GROUP BY n.host, n.guid""")
def _(d):
    return tree.node_detection_join(d.plan.nodes, d.plan.detections).select("host", "guid", "detections", "worst_severity")


def _reputation(d):
    """Two providers' verdicts per destination, from its connection count."""
    net = d.events.filter("event_id = 3").withColumn("ip", F.col("raw")["DestinationIp"])
    by_ip = net.groupBy(F.col("ip").alias("indicator")).agg((F.count("*") % 120).alias("score"), (F.count("*") % 5).alias("flags"), F.max("timestamp").alias("fetched_at"))
    rows = F.array(
        F.struct(F.lit("abuse").alias("provider"), sc.abuse_verdict(F.col("score")).alias("verdict"), (F.col("score") % 3 != 0).alias("available")),
        F.struct(F.lit("vendor").alias("provider"), sc.vendor_verdict(F.col("flags")).alias("verdict"), F.lit(True).alias("available")))
    return by_ip.select("indicator", "score", "flags", "fetched_at", F.inline(rows))


REP = """(SELECT indicator, score, flags, last_us, unnest([{'p': 'abuse', 'v': CASE WHEN score >= 90 THEN 'malicious' WHEN score >= 25 THEN 'suspicious' ELSE 'clean' END, 'a': score % 3 <> 0},
    {'p': 'vendor', 'v': CASE WHEN flags >= 3 THEN 'malicious' WHEN flags > 0 THEN 'suspicious' ELSE 'clean' END, 'a': true}]) AS r
    FROM (SELECT dest_ip AS indicator, count(*) % 120 AS score, count(*) % 5 AS flags, max(us) AS last_us FROM tele WHERE code = 3 GROUP BY 1))"""
WORST = "(['malicious', 'suspicious', 'unknown', 'clean'])[min(list_position(['malicious', 'suspicious', 'unknown', 'clean'], r.v)) FILTER (r.a)]"


@query("reputation_join", f"SELECT t.seq, t.dest_ip AS value, w.verdict FROM tele t JOIN (SELECT indicator, {WORST} AS verdict FROM {REP} GROUP BY 1) w ON w.indicator = t.dest_ip")
def _(d):
    seen = d.events.filter("event_id = 3").select("seq", F.col("raw")["DestinationIp"].alias("value"))
    return tables.reputation_join(seen, _reputation(d)).select("seq", "value", "verdict")


@query("uncovered_techniques", "SELECT id, name FROM catalogue WHERE id NOT IN (SELECT id FROM raised)")
def _(d):
    return coverage.uncovered_techniques(d.catalogue, coverage.rule_counts_by_technique(d.rules)).select("id", "name")


@query("rules_not_fired", "SELECT rule_id, title FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM fired)")
def _(d):
    return matching.rules_not_fired(d.rules, d.plan.detections).select("rule_id", "title")


# -- 2.5 process graph ----------------------------------------------------------------

@query("process_nodes", "SELECT host, guid, parent AS parent_guid, image, cmd AS command_line, first_us, last_us, name FROM nodes")
def _(d):
    return d.plan.nodes.select("host", "guid", "parent_guid", "image", "command_line", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "name")


@query("ancestry", "SELECT host, guid, array_to_string(path, '>') AS path FROM top")
def _(d):
    return d.plan.paths.select("host", "guid", joined("path", ">").alias("path"))


@query("tree_root", "SELECT host, guid, root AS root_guid, depth FROM top")
def _(d):
    return d.plan.roots


@query("subtree", "SELECT t.host, t.root AS root_guid, t.guid, n.name, n.first_us FROM top t JOIN nodes n USING (host, guid)")
def _(d):
    roots = d.plan.roots.filter("depth = 0").select("host", "root_guid")
    return tree.subtree(d.plan.nodes, roots).select("host", "root_guid", "guid", "name", us("first_seen").alias("first_us"))


@query("tree_prune", "SELECT host, guid, last_us FROM nodes WHERE last_us >= (SELECT max(us) FROM tele) - 7 * 86400000000")
def _(d):
    as_of = F.lit(d.events.agg(F.max("timestamp")).first()[0])
    return tree.tree_prune(d.plan.nodes, as_of, ttl_s=7 * DAY_S).select("host", "guid", us("last_seen").alias("last_us"))


@query("process_chain", "SELECT host, guid, root AS root_guid, root_image, array_to_string(chain, '>') AS chain FROM top")
def _(d):
    return tree.process_chain(d.plan.paths).select("host", "guid", "root_guid", "root_image", joined("chain", ">").alias("chain"))


@query("tree_rows", """SELECT a.host, a.guid, t.root AS root_guid, max(a.depth) AS depth, string_agg(lpad(n.first_us::VARCHAR, 17, '0') || '|' || a.cur, '/' ORDER BY a.depth DESC) AS sort_key
    FROM anc a JOIN nodes n ON n.host = a.host AND n.guid = a.cur JOIN top t ON t.host = a.host AND t.guid = a.guid GROUP BY a.host, a.guid, t.root""")
def _(d):
    return tree.tree_rows(d.plan.paths)


# -- 2.6 aggregations -------------------------------------------------------------------

@query("correlate_incidents", """SELECT id, host, root AS root_guid, root_image, score, detection_count, array_to_string(chain, '>') AS chain, first_us, last_us FROM inc""")
def _(d):
    return d.plan.incidents.select("id", "host", "root_guid", "root_image", F.col("score").cast("bigint").alias("score"), "detection_count",
                                   joined("chain", ">").alias("chain"), us("first_seen").alias("first_us"), us("last_seen").alias("last_us"))


@query("incident_score", "SELECT id, score FROM inc")
def _(d):
    return d.plan.incidents.select("id", F.col("score").cast("bigint").alias("score"))


@query("score_severity", "SELECT severity, count(*) AS incidents, min(score) AS low, max(score) AS high FROM inc GROUP BY severity")
def _(d):
    return d.plan.incidents.groupBy("severity").agg(F.count("*").alias("incidents"), F.min("score").cast("bigint").alias("low"), F.max("score").cast("bigint").alias("high"))


@query("incident_techniques", "SELECT id, array_to_string(techniques, ',') AS techniques FROM inc")
def _(d):
    return d.plan.incidents.select("id", joined("techniques").alias("techniques"))


@query("is_actionable", "SELECT id, actionable FROM inc")
def _(d):
    return d.plan.incidents.select("id", "actionable")


@query("incident_classification", "SELECT id, classification FROM inc")
def _(d):
    return d.plan.incidents.select("id", "classification")


@query("incident_title", "SELECT id, title FROM inc")
def _(d):
    return d.plan.incidents.select("id", "title")


@query("incident_sweep", "SELECT id, (SELECT max(us) FROM tele) - last_us > 20 * 86400000000 AS closed FROM inc")
def _(d):
    as_of = F.lit(d.events.agg(F.max("timestamp")).first()[0])
    return inc.incident_sweep(d.plan.incidents, as_of, window_s=20 * DAY_S).select("id", "closed")


@query("indicators", f"""SELECT incident_id, kind, value, coalesce(detail, '') AS detail, coalesce(list(img ORDER BY {o.ORD})[1], '') AS image, min(us) AS us FROM (
    SELECT incident_id, us, seq, source, rule_id, 'user' AS kind, usr AS value, NULL AS detail, NULL AS img FROM members
    UNION ALL SELECT incident_id, us, seq, source, rule_id, 'destination', dest_ip, dest_port || '|', NULL FROM members
    UNION ALL SELECT incident_id, us, seq, source, rule_id, 'hash', regexp_extract(hashes, 'SHA256=([0-9a-f]+)', 1), NULL, {o.BASE.format('image')} FROM members WHERE hashes IS NOT NULL
    UNION ALL SELECT incident_id, us, seq, source, rule_id, 'registry', target_object, NULL, NULL FROM members) WHERE value IS NOT NULL GROUP BY incident_id, kind, value, detail""")
def _(d):
    return evidence.indicators(d.plan.members).select("incident_id", "kind", "value", F.coalesce("detail", F.lit("")).alias("detail"),
                                                      F.coalesce("image", F.lit("")).alias("image"), "us")


@query("privilege_escalation", """SELECT incident_id, (['untrusted', 'low', 'medium', 'high', 'system'])[lo] AS from_level, (['untrusted', 'low', 'medium', 'high', 'system'])[hi] AS to_level FROM (
    SELECT incident_id, count(r) AS n, min(r) AS lo, max(r) AS hi FROM (SELECT incident_id, nullif(list_position(['untrusted', 'low', 'medium', 'high', 'system'], lower(integrity)), 0) AS r FROM members) GROUP BY 1) WHERE n >= 2 AND hi > lo""")
def _(d):
    return evidence.privilege_escalation(d.plan.members)


PROFILE = """SELECT incident_id, replace(tactic, '-', ' ') AS tactic, position, phrase, array_to_string(exact, ',') AS techniques, array_to_string(rule_ids, ',') AS rules FROM phases"""


@query("behavior_profile", """SELECT i.id AS incident_id, CASE WHEN p.n IS NULL THEN 'Suspicious activity on ' || i.host || ' with no clearly profiled behavior.'
    WHEN p.n = 1 THEN 'On ' || i.host || ', the activity ' || p.l[1] || '.' ELSE 'On ' || i.host || ', the activity ' || array_to_string(p.l[:-2], ', ') || ', and ' || p.l[-1] || '.' END AS summary, coalesce(p.n, 0) AS phases
    FROM inc i LEFT JOIN (SELECT incident_id, count(*) AS n, list(phrase ORDER BY position) AS l FROM phases GROUP BY 1) p ON p.incident_id = i.id""")
def _(d):
    out = evidence.behavior_profile(d.plan.incidents, evidence.behavior_phases(d.plan.members))
    return out.select("incident_id", "summary", F.coalesce(F.size("phases"), F.lit(0)).cast("bigint").alias("phases"))


@query("behavior_phases", PROFILE)
def _(d):
    return evidence.behavior_phases(d.plan.members).select("incident_id", "tactic", "position", "phrase", joined("techniques").alias("techniques"), joined("rules").alias("rules"))


@query("coverage_report", """SELECT count(*) AS total_techniques, count(*) FILTER (rule_count > 0) AS covered_techniques, count(*) FILTER (rule_count = 0) AS uncovered_techniques, false AS partial FROM covered""")
def _(d):
    return coverage.coverage_report(coverage.coverage_join(d.catalogue, coverage.rule_counts_by_technique(d.rules)), d.catalogue)


@query("stats_totals", """SELECT count(*) AS incidents, (SELECT count(*) FROM det) AS detections, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'open' AND actionable) AS actionable_open,
    count(*) FILTER (status = 'closed') AS closed, count(*) FILTER (status = 'false_positive') AS false_positive FROM triage""")
def _(d):
    return stats.stats_totals(d.triaged, d.plan.detections)


@query("incidents_per_day", """SELECT strftime(day, '%Y-%m-%d') AS day, count(i.id) AS incidents FROM (SELECT unnest(range(200)) AS n) x
    JOIN (SELECT max(us) AS m FROM tele) ON true JOIN LATERAL (SELECT (make_timestamp(m)::DATE - n::INT)::DATE AS day) ON true LEFT JOIN inc i ON make_timestamp(i.first_us)::DATE = day GROUP BY day""")
def _(d):
    as_of = F.lit(d.events.agg(F.max("timestamp")).first()[0])
    return stats.incidents_per_day(d.plan.incidents, as_of, days=200).select(F.col("day").cast("string").alias("day"), "incidents")


@query("severity_distribution", "SELECT s.severity, count(i.id) AS rows FROM (SELECT unnest(['info', 'low', 'medium', 'high', 'critical']) AS severity) s LEFT JOIN inc i USING (severity) GROUP BY 1")
def _(d):
    return stats.severity_distribution(d.plan.incidents)


@query("top_rules", "SELECT rule_id, count(*) AS detections, list(title ORDER BY us, seq, source)[1] AS title FROM det GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(d):
    return stats.top_rules(d.plan.detections)


@query("top_techniques", "SELECT technique, detections, coalesce(c.name, technique) AS name FROM (SELECT technique, count(*) AS detections FROM (SELECT unnest(attack) AS technique FROM det) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) LEFT JOIN catalogue c ON c.id = technique")
def _(d):
    return stats.top_techniques(d.plan.detections, d.catalogue)


@query("labelled_counter", "SELECT o_orderstatus, o_orderpriority, count(*) AS total FROM orders GROUP BY 1, 2")
def _(d):
    return stats.labelled_counter(d.table("orders"), ["o_orderstatus", "o_orderpriority"])


@query("cumulative_histogram", "SELECT l_returnflag, le, CASE le " + " ".join(
    f"WHEN '{b}' THEN count(*) FILTER (l_discount * 60 <= {b})" for b in m.HISTOGRAM_BOUNDS) + """ ELSE count(*) END AS at_or_below, count(*) AS value_count, round(sum(l_discount * 60), 3) AS value_sum
    FROM lineitem, (SELECT unnest([""" + ", ".join(f"'{b}'" for b in m.HISTOGRAM_BOUNDS) + """, '+Inf']) AS le) GROUP BY 1, 2""")
def _(d):
    rows = d.table("lineitem").select("l_returnflag", (F.col("l_discount") * 60).alias("seconds"))
    return stats.cumulative_histogram(rows, ["l_returnflag"], "seconds").withColumn("value_sum", F.round("value_sum", 3))


@query("replay_summary", "SELECT rule_id, count(*) AS fires, count(DISTINCT incident_id) AS incidents FROM members GROUP BY 1")
def _(d):
    return stats.replay_summary(d.plan.members)


@query("console_counters", """SELECT 'hosts' AS name, count(DISTINCT host) AS total FROM det UNION ALL SELECT 'techniques', count(DISTINCT t) FROM (SELECT unnest(attack) AS t FROM det)
    UNION ALL SELECT severity, count(*) FROM det GROUP BY severity UNION ALL SELECT * FROM (SELECT t, count(*) AS n FROM (SELECT unnest(attack) AS t FROM det) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12)""")
def _(d):
    totals, severities, top = stats.console_counters(d.plan.detections)
    totals = totals.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("total")) for c in ("hosts", "techniques")])))
    return totals.unionByName(severities.select(F.col("severity").alias("name"), F.col("detections").alias("total"))).unionByName(
        top.select(F.col("technique").alias("name"), F.col("detections").alias("total")))


@query("engine_counters", """SELECT 'events_seen' AS counter, count(*) AS total FROM tele UNION ALL SELECT 'rules_loaded', count(*) FROM rules UNION ALL SELECT 'processes_tracked', count(*) FROM nodes
    UNION ALL SELECT 'open_incidents', count(*) FROM inc WHERE (SELECT max(us) FROM tele) - last_us <= 864000000000
    UNION ALL SELECT 'channels_watched', count(*) FROM (SELECT DISTINCT host, process, dest_ip, dest_port FROM conn)
    UNION ALL SELECT 'bursts_watched', count(*) FROM (SELECT DISTINCT host, root FROM recon) UNION ALL SELECT 'scans_watched', count(*) FROM (SELECT DISTINCT host, process, guid FROM conn)""")
def _(d):
    as_of = F.lit(d.events.agg(F.max("timestamp")).first()[0])
    open_ones = inc.incident_sweep(d.plan.incidents, as_of, window_s=10 * DAY_S).filter("NOT closed")
    return stats.engine_counters(d.events, d.rules, d.plan.nodes, open_ones, d.conns.select(*CHANNEL).distinct(),
                                 d.recon.select("host", "root_guid").distinct(), d.conns.select("host", "process", "process_guid").distinct())


# -- 2.7 windows and sequences -------------------------------------------------------------

@query("channel_intervals", "SELECT seq, host, us, coalesce((us - lag(us) OVER (PARTITION BY host, process, dest_ip, dest_port ORDER BY us, seq)) / 1e6, -1) AS interval_s FROM conn")
def _(d):
    return detectors.channel_intervals(d.conns).select("seq", "host", "us", F.coalesce("interval_s", F.lit(-1.0)).alias("interval_s"))


@query("trailing_64", "SELECT seq, len(frame) AS held, frame[1] AS oldest_us, frame[-1] AS newest_us FROM beacon_frames")
def _(d):
    f = F.col("frame")
    return detectors.trailing_64(d.conns).select("seq", F.size(f).cast("bigint").alias("held"), F.element_at(f, 1).alias("oldest_us"), F.element_at(f, -1).alias("newest_us"))


MEDIAN = "({0}[(len({0}) - 1) // 2 + 1] + {0}[len({0}) // 2 + 1]) / 2.0"


@query("regularity", f"""SELECT host, process, dest_ip, dest_port, n AS connections, round(med / 1e6, 3) AS median_s, round(CASE WHEN len(gaps) >= 2 AND med > 0 THEN greatest(least(1 - ({MEDIAN.format("devs")}) / med, 1.0), 0.0) ELSE 0.0 END, 6) AS regularity FROM (
    SELECT *, list_sort([abs(g - med) for g in gaps]) AS devs FROM (SELECT *, {MEDIAN.format("gaps")} AS med, len(frame) AS n FROM (SELECT *, list_sort([frame[i + 1] - frame[i] for i in range(1, len(frame))]) AS gaps FROM (
      SELECT host, process, dest_ip, dest_port, list_sort(list(us)) AS frame FROM (SELECT * FROM conn QUALIFY row_number() OVER (PARTITION BY host, process, dest_ip, dest_port ORDER BY us DESC, seq DESC) <= 64) GROUP BY 1, 2, 3, 4))))""")
def _(d):
    out = detectors.channel_regularity(d.conns)
    return out.select(*CHANNEL, F.col("connections").cast("bigint").alias("connections"), F.round("median_s", 3).alias("median_s"), F.round("regularity", 6).alias("regularity"))


@query("beacon_detect", """SELECT seq, host, us, CASE WHEN regularity >= 0.92 THEN 'critical' ELSE 'high' END AS severity, len(frame) AS connections, dest_ip || ':' || dest_port AS destination,
    round(regularity, 3) AS regularity FROM beacon_alerts""")
def _(d):
    e = F.col("evidence")
    return detectors.beacon_detect(d.events, **BEACON).select(
        "seq", "host", us("matched_at").alias("us"), "severity", e["connections"].cast("bigint").alias("connections"), e["destination"].alias("destination"),
        e["regularity"].cast("double").alias("regularity"))


@query("cooldown_filter", "SELECT host, us FROM cool_kept", cool_cand="SELECT host, us, seq FROM tele WHERE code = 1",
       cool_kept=o.cooldown_cte("cool_cand", "host", 3_600_000_000).format(self="cool_kept"))
def _(d):
    out = ordering.cooldown_filter(d.events.filter("event_id = 1").select("host", us("timestamp").alias("us"), "seq"), ["host"], "us", "seq", 3_600_000_000)
    return out.select("host", "us")


@query("discovery_classify", "SELECT seq, " + o.case([(f"regexp_matches(cmd, {o.q(p)}, 'i')", o.q(t)) for t, _l, p in m.DISCOVERY_SIGNATURES]) + " AS technique, "
       + o.case([(f"regexp_matches(cmd, {o.q(p)}, 'i')", o.q(lab)) for _t, lab, p in m.DISCOVERY_SIGNATURES]) + " AS label FROM tele WHERE code = 1")
def _(d):
    hit = detectors.discovery_classify(F.col("command_line"))
    return d.events.filter("event_id = 1").withColumn("hit", hit).select("seq", F.col("hit.technique").alias("technique"), F.col("hit.label").alias("label"))


@query("discovery_burst", """SELECT a.seq, a.host, a.us, a.kinds AS distinct_techniques, CASE WHEN a.kinds >= 5 THEN 'high' ELSE 'medium' END AS severity,
    string_agg(DISTINCT s.technique, ',' ORDER BY s.technique) AS attack, round_even((max(s.us) - min(s.start_us)) / 1e6, 0)::BIGINT AS span_s
    FROM disc_alerts a JOIN disc_sess s ON s.host = a.host AND s.root = a.root AND s.us >= a.us - 1800000000 AND (s.us < a.us OR (s.us = a.us AND s.seq <= a.seq)) GROUP BY a.seq, a.host, a.us, a.kinds""")
def _(d):
    out = detectors.discovery_burst(d.events, d.plan.roots, **DISCOVERY)
    e = F.col("evidence")
    return out.select("seq", "host", us("matched_at").alias("us"), e["distinct_techniques"].cast("bigint").alias("distinct_techniques"), "severity",
                      joined("attack").alias("attack"), e["span_seconds"].cast("bigint").alias("span_s"))


@query("scan_detect", """SELECT seq, host, us, ips AS distinct_ips, ports AS distinct_ports, pairs AS distinct_pairs, CASE WHEN ips >= 2 AND ports >= 3 THEN 'network scan' WHEN ips >= 2 THEN 'host sweep' ELSE 'port scan' END AS shape,
    CASE WHEN ips >= 4 OR ports >= 6 THEN 'critical' ELSE 'high' END AS severity, array_to_string(sample, ',') AS sample, CASE WHEN ips >= 2 THEN 'T1046,T1018' ELSE 'T1046' END AS attack FROM scan_alerts""")
def _(d):
    out = detectors.scan_detect(d.events, **SCAN)
    e = F.col("evidence")
    return out.select("seq", "host", us("matched_at").alias("us"), *[e[c].cast("bigint").alias(c) for c in ("distinct_ips", "distinct_ports", "distinct_pairs")],
                      F.regexp_extract("title", "^Network ([a-z ]+):", 1).alias("shape"), "severity",
                      F.array_join(F.from_json(e["sample_destinations"], "array<string>"), ",").alias("sample"), joined("attack").alias("attack"))


@query("timeline_gaps", f"SELECT incident_id, seq, rule_id, coalesce((us - lag(us) OVER (PARTITION BY incident_id ORDER BY {o.ORD})) / 1e6, -1) AS gap_s FROM members")
def _(d):
    return inc.timeline_gaps(d.plan.members).select("incident_id", "seq", "rule_id", F.coalesce("gap_s", F.lit(-1.0)).alias("gap_s"))


@query("running_last_seen", f"SELECT incident_id, seq, rule_id, max(us) OVER w AS last_us, row_number() OVER w AS ordinal FROM members WINDOW w AS (PARTITION BY incident_id ORDER BY {o.ORD} ROWS UNBOUNDED PRECEDING)")
def _(d):
    return inc.running_last_seen(d.plan.members).select("incident_id", "seq", "rule_id", us("last_seen").alias("last_us"), "ordinal")


# -- 2.8 sorts, limits, top-k ------------------------------------------------------------------

@query("latest_detections", "SELECT seq, rule_id, us, (SELECT count(*) FROM det) AS total FROM det ORDER BY us DESC, seq DESC, source DESC, rule_id DESC LIMIT 100")
def _(d):
    rows = stats.latest_detections(d.plan.detections, 100).select("seq", "rule_id", us("matched_at").alias("us"))
    return rows.withColumn("total", F.lit(d.plan.detections.count()))


@query("latest_incidents", "SELECT id, last_us FROM inc WHERE actionable ORDER BY last_us DESC, id LIMIT 50")
def _(d):
    return stats.latest_incidents(d.plan.incidents, 50, actionable_only=True).select("id", us("last_seen").alias("last_us"))


@query("incidents_by_status", "SELECT id, last_us FROM triage WHERE status = 'closed'")
def _(d):
    return stats.incidents_by_status(d.triaged, "closed").select("id", us("last_seen").alias("last_us"))


@query("triage_queue", "SELECT id, status, last_us FROM triage WHERE actionable AND status = 'open'")
def _(d):
    return stats.triage_queue(d.triaged).select("id", "status", us("last_seen").alias("last_us"))


HAY = "lower(concat_ws(' ', rule_id, title, image, coalesce(parent_image, ''), coalesce(cmd, ''), host, usr, coalesce(hashes, ''), coalesce(dest_ip, ''), '', coalesce(target_object, ''), coalesce(target_image, ''), array_to_string(attack, ' ')))"


@query("search_rank", "SELECT incident_id, match_count FROM ("
       "SELECT i.id AS incident_id, i.last_us, coalesce(h.n, 0) AS match_count, lower(i.title || ' ' || array_to_string(i.chain, ' ')) AS text FROM inc i LEFT JOIN hits h ON h.incident_id = i.id) WHERE match_count > 0 OR contains(text, 'whoami') ",
       hits=f"SELECT incident_id, count(*) AS n FROM members WHERE contains({HAY}, 'whoami') GROUP BY 1")
def _(d):
    hits = search.search_rank(search.search_incidents(d.plan.incidents, d.plan.members, terms=["WhoAmI"]))
    return hits.select("incident_id", "match_count")


@query("noise_top3", "SELECT p.id, r.matched_id, r.score, r.place FROM prints p JOIN ranked r USING (fp) WHERE p.status = 'open' AND r.place <= 3", **NOISE)
def _(d):
    return similarity.noise_top3(*_noise(d, similarity.MAX_MATCHES)).select("id", "matched_id", "score", F.col("rank").cast("bigint").alias("place"))


@query("sample_first_n", "SELECT host, array_to_string(list_sort(list(DISTINCT dest_ip || ':' || dest_port))[:10], ',') AS sample FROM conn GROUP BY host")
def _(d):
    pairs = d.conns.select("host", F.concat_ws(":", "dest_ip", "dest_port").alias("dest")).distinct()
    return ordering.sample_first_n(pairs, ["host"], "dest", 10).select("host", joined("sample").alias("sample"))


# -- 2.9 set operations ---------------------------------------------------------------------------

@query("all_detections", """SELECT 'rule' AS source, count(*) AS detections, sum(seq)::BIGINT AS seqs FROM rdet UNION ALL SELECT 'beacon', count(*), sum(seq)::BIGINT FROM beacon_alerts HAVING count(*) > 0
    UNION ALL SELECT 'discovery', count(*), sum(seq)::BIGINT FROM disc_alerts HAVING count(*) > 0
    UNION ALL SELECT 'scan', count(*), sum(seq)::BIGINT FROM scan_alerts HAVING count(*) > 0""")
def _(d):
    plan = d.plan
    name = F.element_at(F.lit(["rule", "beacon", "discovery", "scan"]), F.col("source") + 1)
    return plan.detections.groupBy(name.alias("source")).agg(F.count("*").alias("detections"), F.sum("seq").alias("seqs"))


@query("jaccard", """SELECT id, round(len(list_intersect(techniques, ['T1059', 'T1003.001', 'T1082', 'T1571'])) / len(list_distinct(list_concat(techniques, ['T1059', 'T1003.001', 'T1082', 'T1571']))), 6) AS likeness FROM inc""")
def _(d):
    return d.plan.incidents.select("id", F.round(similarity.jaccard(F.col("techniques"), F.lit(["T1059", "T1003.001", "T1082", "T1571"])), 6).alias("likeness"))


@query("noise_similarity", "SELECT fp, matched_fp, round(score, 6) AS score, array_to_string([r for r in [CASE WHEN rules >= 0.5 THEN 'same detection rules' END, CASE WHEN techniques >= 0.5 THEN 'same ATT&CK techniques' END, "
       "CASE WHEN root THEN 'same root process' END, CASE WHEN chains >= 0.5 THEN 'overlapping process chain' END] if r IS NOT NULL], '; ') AS matched_on FROM parts", **NOISE,
       parts="SELECT n.fp, n.matched_fp, n.score, a.root <> '' AND a.root = b.root AS root, " + ", ".join(
           f"len(list_intersect(a.{c}, b.{c})) / {UNION_SIZE.format(c)} AS {alias}" for c, alias in (("rule_ids", "rules"), ("techniques", "techniques"), ("chain", "chains"))
       ) + " FROM noisy n JOIN open_kinds a ON a.fp = n.fp JOIN past_kinds b ON b.fp = n.matched_fp")
def _(d):
    return _noise(d)[2].select("fp", "matched_fp", F.round("score", 6).alias("score"), joined("matched_on", "; ").alias("matched_on"))


@query("noise_open_only", "SELECT p.id, coalesce(r.score, -1) AS noise_score FROM prints p LEFT JOIN ranked r ON r.fp = p.fp AND r.place = 1 WHERE p.status = 'open'", **NOISE)
def _(d):
    return similarity.noise_open_only(d.triaged, similarity.noise_top3(*_noise(d, similarity.MAX_MATCHES))).select("id", F.coalesce("noise_score", F.lit(-1.0)).alias("noise_score"))


# -- 2.10 search -------------------------------------------------------------------------------------

@query("search_incidents", "SELECT i.id AS incident_id, i.title, i.last_us, h.n AS match_count FROM inc i JOIN hits h ON h.incident_id = i.id WHERE i.severity = 'critical' AND contains(lower(i.host), 'h')",
       hits=f"SELECT incident_id, count(*) AS n FROM members WHERE severity = 'critical' AND contains(lower(host), 'h') AND len([t for t in attack if starts_with(lower(t), 't1003')]) > 0 AND contains({HAY}, 'lsass') GROUP BY 1")
def _(d):
    hits = search.search_incidents(d.plan.incidents, d.plan.members, terms=["lsass"], filters={"severity": "critical", "technique": "T1003", "host": "h"})
    return hits.select("incident_id", "title", us("last_seen").alias("last_us"), "match_count")


@query("search_hits", f"""SELECT m.incident_id, m.seq, m.rule_id, coalesce(h.hit, false) AS matched FROM (SELECT *, {HAY} AS hay FROM members) m JOIN inc i ON i.id = m.incident_id
    LEFT JOIN found h ON h.incident_id = m.incident_id WHERE CASE WHEN h.hit THEN contains(m.hay, 'powershell') ELSE contains(lower(i.title || ' ' || array_to_string(i.chain, ' ')), 'powershell') END""",
       found=f"SELECT DISTINCT incident_id, true AS hit FROM members WHERE contains({HAY}, 'powershell')")
def _(d):
    return search.search_hits(d.plan.incidents, d.plan.members, terms=["PowerShell"]).select("incident_id", "seq", "rule_id", "matched")


@query("detection_haystack", f"SELECT seq, rule_id, md5({HAY}) AS digest FROM det")
def _(d):
    return d.plan.detections.select("seq", "rule_id", F.md5(search.detection_haystack()).alias("digest"))


@query("detection_filters", "SELECT seq, rule_id FROM det WHERE contains(lower(usr), 'u1') AND severity = 'high' AND contains(lower(coalesce(cmd, '')), 'net')")
def _(d):
    keep = search.detection_filters({"user": "u1", "severity": "high", "command_line": "net"})
    return d.plan.detections.filter(keep).select("seq", "rule_id")


@query("incident_filters", "SELECT id FROM inc WHERE severity = 'high' AND NOT actionable AND contains(lower(host), '3')")
def _(d):
    return d.plan.incidents.filter(search.incident_filters({"severity": "high", "actionable": "no", "host": "3"})).select("id")


# -- 2.11 scalar functions -------------------------------------------------------------------------------

@query("parse_hashes", "SELECT doc_id, md5(text) AS md5, sha256(source) AS sha256, 2 AS entries FROM documents")
def _(d):
    raw = F.concat(F.lit("SHA256="), F.sha2("source", 256), F.lit(",junk, Md5 = 0,MD5="), F.md5("text"))
    h = F.col("h")
    return d.table("documents").withColumn("h", sc.parse_hashes(raw)).select("doc_id", h["md5"].alias("md5"), h["sha256"].alias("sha256"), F.size(h).alias("entries"))


@query("best_hash", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN sha256(source) WHEN 1 THEN md5(source) ELSE sha1(source) END AS best FROM documents")
def _(d):
    raw = F.concat_ws(",", F.concat(F.lit("MD5="), F.md5("source")), F.when(F.col("doc_id") % 3 != 1, F.concat(F.lit("SHA1="), F.sha1("source"))),
                      F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("SHA256="), F.sha2("source", 256))))
    return d.table("documents").select("doc_id", sc.best_hash(sc.parse_hashes(raw)).alias("best"))


IPV4 = "((o_orderkey % 256) || '.' || (o_custkey % 256) || '.' || (o_orderkey // 7 % 256) || '.' || (o_custkey // 3 % 256))"
V4_RANGES = " OR ".join(f"n BETWEEN {sc._v4_const(a)} AND {sc._v4_const(a) + 2 ** (32 - b) - 1}" for a, b in sc.NON_PUBLIC_V4)


@query("classify_indicator", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CASE WHEN ({V4_RANGES}) AND ip NOT IN ('192.0.0.9', '192.0.0.10') THEN NULL ELSE 'ip' END WHEN o_orderkey % 4 = 2 THEN 'hash' WHEN o_custkey % 2 = 0 THEN 'domain' END AS kind
    FROM (SELECT *, (o_orderkey % 256) * 16777216 + (o_custkey % 256) * 65536 + (o_orderkey // 7 % 256) * 256 + o_custkey // 3 % 256 AS n, {IPV4} AS ip FROM orders)""")
def _(d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    ip = F.concat_ws(".", *[x.cast("string") for x in (key % 256, cust % 256, F.expr("o_orderkey div 7 % 256"), F.expr("o_custkey div 3 % 256"))])
    name = F.when(cust % 2 == 0, F.concat(F.lit("host"), key.cast("string"), F.lit(".example.com"))).otherwise(F.lit("not a.domain"))
    value = F.when(key % 4 < 2, ip).when(key % 4 == 2, F.md5(key.cast("string"))).otherwise(name)
    return d.table("orders").select("o_orderkey", sc.classify_indicator(value).alias("kind"))


@query("verdict_bands", "SELECT o_orderkey, CASE WHEN s >= 90 THEN 'malicious' WHEN s >= 25 THEN 'suspicious' ELSE 'clean' END AS abuse, CASE WHEN f IS NULL THEN 'unknown' WHEN f >= 3 THEN 'malicious' WHEN f > 0 THEN 'suspicious' ELSE 'clean' END AS vendor FROM (SELECT o_orderkey, o_custkey % 101 AS s, nullif(o_orderkey % 6, 5) AS f FROM orders)")
def _(d):
    return d.table("orders").select("o_orderkey", sc.abuse_verdict(F.col("o_custkey") % 101).alias("abuse"), sc.vendor_verdict(F.nullif(F.col("o_orderkey") % 6, F.lit(5))).alias("vendor"))


@query("worst_verdict", f"SELECT indicator, {WORST} AS verdict FROM {REP} GROUP BY 1")
def _(d):
    return _reputation(d).groupBy("indicator").agg(sc.worst_verdict(F.col("verdict"), F.col("available")).alias("verdict"))


@query("reputation_ttl", f"SELECT indicator, r.p AS provider, r.v AS verdict FROM {REP} WHERE (SELECT max(us) FROM tele) - last_us < 1800000000")
def _(d):
    as_of = F.lit(d.events.agg(F.max("timestamp")).first()[0])
    return tables.reputation_ttl(_reputation(d), as_of, ttl_s=1800).select("indicator", "provider", "verdict")


@query("technique_tactic", "SELECT t.id, coalesce(a.tactic, b.tactic) AS title_tactic, coalesce(c.tactic, e.tactic) AS phase FROM (SELECT 'T' || (1000 + p_partkey % 700) || CASE WHEN p_partkey % 3 > 0 THEN '.00' || (p_partkey % 3) ELSE '' END AS id FROM part) t "
       "LEFT JOIN tactic_of a ON a.technique = t.id LEFT JOIN tactic_of b ON b.technique = split_part(t.id, '.', 1) LEFT JOIN phase_of c ON c.technique = t.id LEFT JOIN phase_of e ON e.technique = split_part(t.id, '.', 1)")
def _(d):
    key = F.col("p_partkey")
    tid = F.concat(F.lit("T"), (key % 700 + 1000).cast("string"), F.when(key % 3 > 0, F.concat(F.lit(".00"), (key % 3).cast("string"))).otherwise(""))
    rows = d.table("part").select(tid.alias("id"))
    return rows.select("id", m.technique_tactic(F.col("id")).alias("title_tactic"), m.technique_tactic(F.col("id"), m.NARRATIVE_TACTICS).alias("phase"))


RUNS = "[r for r in regexp_extract_all(text, '[A-Za-z0-9+/]{16,}={0,2}') if len(r) % 4 = 0 AND NOT (regexp_full_match(r, '[0-9a-fA-F]+') AND len(r) <= 64) AND len(list_distinct(regexp_split_to_array(r, ''))) >= 8]"


def _base64_text():
    """Whole texts; half of them in base64 after a word, so that there is something to find."""
    return F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("run "), F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", ""))).otherwise(F.col("text"))


@query("base64_runs", f"SELECT doc_id, len(runs) AS runs, md5(array_to_string(runs, ' ')) AS digest FROM (SELECT doc_id, {RUNS} AS runs FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'run ' || base64(encode(text)) ELSE text END AS text FROM documents))")
def _(d):
    runs = d.table("documents").select("doc_id", sc.base64_runs(_base64_text()).alias("r"))
    return runs.select("doc_id", F.size("r").cast("bigint").alias("runs"), F.md5(F.array_join("r", " ")).alias("digest"))


@query("base64_decode_text", "SELECT doc_id, md5(CASE WHEN doc_id % 4 = 2 THEN regexp_replace(text, '[^\\x20-\\x7e]', '', 'g') ELSE text END) AS digest, (doc_id % 4 = 2) AS is_utf16 FROM documents")
def _(d):
    plain = F.regexp_replace("text", r"[^\x20-\x7e]+", "")
    data = F.when(F.col("doc_id") % 4 == 2, F.encode(plain, "UTF-16LE")).otherwise(F.encode("text", "UTF-8"))
    rows = d.table("documents").select("doc_id", sc.base64_decode_text(F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))).alias("t"))
    return rows.select("doc_id", F.md5("t.text").alias("digest"), F.col("t.is_utf16").alias("is_utf16"))


@query("utc_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM events GROUP BY 1")
def _(d):
    return d.events.groupBy(sc.utc_day(F.col("timestamp")).cast("string").alias("day")).agg(F.count("*").alias("events"))


@query("iso_millis_z", "SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp FROM events")
def _(d):
    return d.events.select("seq", sc.iso_millis_z(F.col("timestamp")).alias("stamp"))


UUID5 = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ('89ab89ab89ab89ab')[('0x' || substr(h, 17, 1))::INT + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query("uuid5", f"SELECT doc_id, {UUID5} AS id FROM (SELECT doc_id, sha1(unhex('{uuid.NAMESPACE_URL.hex}') || encode(text)) AS h FROM documents)")
def _(d):
    return d.table("documents").select("doc_id", sc.uuid5_url(F.col("text")).alias("id"))


@query("stix_escape", r"SELECT seq, replace(replace(image || '''s', '\', '\\'), '''', '\''') AS escaped FROM tele")
def _(d):
    return d.events.select("seq", sc.pattern_escape(F.concat("image", F.lit("'s"))).alias("escaped"))


@query("word_count", r"SELECT doc_id, len([w for w in regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+') if w <> '']) AS words, len([w for w in regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+') if w <> '']) <= 500 AS accepted FROM documents")
def _(d):
    return d.table("documents").select("doc_id", sc.word_count(F.col("text")).cast("bigint").alias("words"), sc.note_accepted(F.col("text")).alias("accepted"))


@query("technique_ids_from_tags", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'T' || (1000 + p_partkey % 900) || ',T1059.001' ELSE 'T' || (1000 + p_partkey % 900) END AS ids FROM part WHERE 1000 + p_partkey % 900 < 1059 OR p_partkey % 2 = 1 "
       "UNION ALL SELECT p_partkey, CASE WHEN 1000 + p_partkey % 900 = 1059 THEN 'T1059,T1059.001' ELSE 'T1059.001,T' || (1000 + p_partkey % 900) END FROM part WHERE 1000 + p_partkey % 900 >= 1059 AND p_partkey % 2 = 0")
def _(d):
    tid = F.concat(F.lit(" Attack.t"), (F.col("p_partkey") % 900 + 1000).cast("string"))
    tags = F.array(tid, F.lit("attack.execution"), F.when(F.col("p_partkey") % 2 == 0, F.lit("attack.T1059.001")).otherwise("attack.t12"), tid)
    return d.table("part").select("p_partkey", F.array_join(sc.techniques_from_tags(tags), ",").alias("ids"))


# -- 2.12 exports ------------------------------------------------------------------------------------------

@query("navigator_layer", "SELECT count(*) AS techniques, greatest(max(rule_count), 1) AS max_value, sum(rule_count)::BIGINT AS score_sum, md5(string_agg(id || '=' || rule_count || '=' || CASE WHEN rule_count > 0 THEN rule_count || ' rule(s)/detector(s)' ELSE 'No rule coverage' END, ';' ORDER BY id)) AS digest FROM covered")
def _(d):
    covered = coverage.coverage_join(d.catalogue, coverage.rule_counts_by_technique(d.rules))
    layer = F.from_json("layer", "techniques array<struct<techniqueID:string,score:bigint,comment:string>>, gradient struct<maxValue:bigint>")
    rows = exports.navigator_layer(covered).select(layer.alias("l"))
    listed = F.transform("l.techniques", lambda t: F.concat_ws("=", t["techniqueID"], t["score"].cast("string"), t["comment"]))
    return rows.select(F.size("l.techniques").cast("bigint").alias("techniques"), F.col("l.gradient.maxValue").alias("max_value"),
                       F.aggregate("l.techniques", F.lit(0).cast("bigint"), lambda a, t: a + t["score"]).alias("score_sum"), F.md5(F.array_join(listed, ";")).alias("digest"))


STIX_ID = "'{kind}--' || (SELECT " + UUID5 + " FROM (SELECT sha1(unhex('" + uuid.NAMESPACE_URL.hex + "') || encode('emberwatch:{kind}:' || {seed})) AS h))"
PATTERN = """SELECT DISTINCT incident_id, pattern FROM (
    SELECT incident_id, '[ipv4-addr:value = ''' || dest_ip || ''']' AS pattern FROM members UNION ALL
    SELECT incident_id, '[file:hashes.SHA256 = ''' || regexp_extract(hashes, 'SHA256=([0-9a-f]+)', 1) || ''']' FROM members WHERE hashes IS NOT NULL UNION ALL
    SELECT incident_id, '[windows-registry-key:key = ''' || replace(target_object, chr(92), chr(92) || chr(92)) || ''']' FROM members) WHERE pattern IS NOT NULL"""


@query("stix_objects", "SELECT NULL::VARCHAR AS incident_id, 'identity' AS type, " + STIX_ID.format(kind="identity", seed="'emberwatch'") + " AS id, strftime(make_timestamp(min(first_us)), '%Y-%m-%dT%H:%M:%S.%gZ') AS created, 'emberwatch' AS name FROM inc HAVING count(*) > 0 "
       "UNION ALL SELECT incident_id, 'attack-pattern', " + STIX_ID.format(kind="attack-pattern", seed="t") + ", created, t FROM (SELECT id AS incident_id, unnest(techniques) AS t, strftime(make_timestamp(first_us), '%Y-%m-%dT%H:%M:%S.%gZ') AS created FROM inc) "
       "UNION ALL SELECT p.incident_id, 'indicator', " + STIX_ID.format(kind="indicator", seed="p.pattern") + ", strftime(make_timestamp(i.first_us), '%Y-%m-%dT%H:%M:%S.%gZ'), p.pattern FROM patterns p JOIN inc i ON i.id = p.incident_id "
       "UNION ALL SELECT id, 'report', " + STIX_ID.format(kind="report", seed="inc.id") + ", strftime(make_timestamp(first_us), '%Y-%m-%dT%H:%M:%S.%gZ'), title FROM inc", patterns=PATTERN)
def _(d):
    members = d.plan.members
    summaries = evidence.behavior_profile(d.plan.incidents, evidence.behavior_phases(members))
    out = exports.stix_objects(d.plan.incidents, evidence.indicators(members), summaries)
    get = lambda k: F.get_json_object("object", f"$.{k}")
    return out.select("incident_id", "type", "id", get("created").alias("created"), F.coalesce(get("pattern"), get("name")).alias("name"))


BUNDLE_REFS = ("SELECT id AS incident_id, 2 AS place, " + STIX_ID.format(kind="attack-pattern", seed="t") + " AS oid FROM (SELECT id, unnest(techniques) AS t FROM inc) "
               "UNION ALL SELECT incident_id, 3, " + STIX_ID.format(kind="indicator", seed="pattern") + " FROM patterns")
BUNDLE_IDS = ("SELECT id AS incident_id, " + STIX_ID.format(kind="bundle", seed="inc.id") + " AS bundle, " + STIX_ID.format(kind="identity", seed="'emberwatch'")
              + " AS producer, " + STIX_ID.format(kind="report", seed="inc.id") + " AS report FROM inc")


@query("stix_bundles", """SELECT incident_id, 0 AS place, bundle AS id, '{"type":"bundle","id":"' || bundle || '","objects":[' AS line FROM bundle_ids
    UNION ALL SELECT incident_id, 1, producer, NULL FROM bundle_ids UNION ALL SELECT incident_id, place, oid, NULL FROM bundle_refs
    UNION ALL SELECT incident_id, 4, report, NULL FROM bundle_ids UNION ALL SELECT incident_id, 5, oid, ',"' || oid || '"' FROM bundle_refs
    UNION ALL SELECT incident_id, 6, bundle, ']}]}' FROM bundle_ids""", patterns=PATTERN, bundle_refs=BUNDLE_REFS, bundle_ids=BUNDLE_IDS)
def _(d):
    members = d.plan.members
    summaries = evidence.behavior_profile(d.plan.incidents, evidence.behavior_phases(members))
    lines = exports.stix_bundle_lines(d.plan.incidents, evidence.indicators(members), summaries)
    framing = F.col("place").isin(exports.BUNDLE_OPEN, exports.BUNDLE_REF, exports.BUNDLE_CLOSE)
    return lines.withColumn("line", F.when(framing, F.col("line")))


@query("incident_report_rows", """SELECT id AS incident_id, 'summary' AS section, '01' AS position, 'Severity' AS label, severity || ' (score ' || score || ')' AS content FROM inc
    UNION ALL SELECT id, 'summary', '00', 'Host', host FROM inc UNION ALL SELECT id, 'summary', '02', 'Detections', detection_count::VARCHAR FROM inc
    UNION ALL SELECT id, 'summary', '04', 'Last seen', strftime(make_timestamp(last_us), '%Y-%m-%d %H:%M:%S UTC') FROM inc
    UNION ALL SELECT id, 'summary', '06', 'Techniques', coalesce(nullif(array_to_string(techniques, ', '), ''), 'none') FROM inc
    UNION ALL SELECT id, 'summary', '05', 'Process chain', array_to_string(chain, ' -> ') FROM inc UNION ALL SELECT id, 'summary', '03', 'First seen', strftime(make_timestamp(first_us), '%Y-%m-%d %H:%M:%S UTC') FROM inc
    UNION ALL SELECT incident_id, 'behavior', lpad(position::VARCHAR, 2, '0'), upper(replace(tactic, '-', ' ')), phrase FROM phases
    UNION ALL SELECT incident_id, 'timeline', lpad(us::VARCHAR, 17, '0') || '-' || lpad(seq::VARCHAR, 19, '0') || '-' || source || '-' || rule_id, rule_id, strftime(make_timestamp(us), '%H:%M:%S') || ' ' || severity FROM members""")
def _(d):
    members = d.plan.members
    profile = evidence.behavior_profile(d.plan.incidents, evidence.behavior_phases(members))
    rows = evidence.incident_report_rows(d.plan.incidents, members, profile)
    get = lambda k: F.get_json_object("content", f"$.{k}")
    content = F.when(F.col("section") == "timeline", F.concat_ws(" ", get("time"), get("severity"))).otherwise(F.col("content"))
    return rows.select("incident_id", "section", "position", "label", content.alias("content"))


# -- 2.13 streaming ------------------------------------------------------------------------------------------
# Each runs the events through a stream to its end, in BATCHES micro-batches by time, and is checked against the batch result.

BATCHES = 6
FILE_ROWS = 10_000


def _stream(d, rows: DataFrame | None = None, batch=None) -> DataFrame:
    """Events as a stream of one file a micro-batch; `batch` (a column of 0 to BATCHES - 1) says which, else their time does."""
    rows = d.events if rows is None else rows
    if batch is None:
        lo, hi = rows.agg(F.min(us("timestamp")), F.max(us("timestamp"))).first()
        batch = F.expr(f"int((unix_micros(timestamp) - {lo or 0}L) div {max(1, ((hi or 0) - (lo or 0)) // BATCHES + 1)}L)")
    # Written once by batch, so that a batch reads its own rows.
    parts, path = d.scratch(), d.scratch()
    rows.withColumn("_batch", batch).write.partitionBy("_batch").parquet(parts)
    kept = d.spark.read.schema(StructType([*rows.schema.fields, StructField("_batch", IntegerType())])).parquet(parts)
    # As many files a batch as can be read side by side, if there are rows for them; every batch has as many.
    files = max(1, min(d.spark.sparkContext.defaultParallelism, kept.count() // (BATCHES * FILE_ROWS)))
    for b in range(BATCHES):
        mine = kept.filter(F.col("_batch") == b).drop("_batch")
        mine.repartition(files).write.parquet(f"{path}/{b}")
        written = len(d.spark.read.schema(mine.schema).parquet(f"{path}/{b}").inputFiles())
        for _ in range(files - written):
            mine.limit(0).coalesce(1).write.mode("append").parquet(f"{path}/{b}")
    return flow.stream_events(d.spark, f"{path}/*", fmt="parquet", files_per_trigger=files)


def _finished(d, rows: DataFrame, mode: str = "append") -> DataFrame:
    d.spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = d.scratch()
    flow.live_push(rows, path, d.scratch(), mode=mode).awaitTermination()
    return flow.published(d.spark, path, rows.schema).drop("batch")


@query("stream_events", f"SELECT CASE WHEN seq % 5 < 3 THEN code ELSE 0 END AS event_id, CASE WHEN seq % 5 = 4 THEN 'unknown' ELSE host END AS host, count(*) AS events, count(*) AS numbers FROM tele WHERE seq % 25 NOT IN (4, 9, 14) AND seq % 25 <> 19 GROUP BY 1, 2")
def _(d):
    path = d.scratch()
    tel.payloads(d.events).select("value").write.text(path)
    rows = _finished(d, flow.stream_events(d.spark, path, max_bytes=2000).select("event_id", "host", "seq"))
    return rows.groupBy("event_id", "host").agg(F.count("*").alias("events"), F.countDistinct("seq").alias("numbers"))


@query("stream_match_rules", "SELECT seq, rule_id FROM rdet")
def _(d):
    return _finished(d, flow.stream_match_rules(_stream(d), d.plan.rules).select("seq", "rule_id"))


@query("live_push", "SELECT rule_id, count(*) AS detections FROM rdet GROUP BY 1")
def _(d):
    rows = _finished(d, flow.stream_match_rules(_stream(d), d.plan.rules).select("seq", "rule_id", "title"))
    return rows.groupBy("rule_id").agg(F.count("*").alias("detections"))


@query("stream_beacon", "SELECT host, dest_ip, dest_port, us, seq, len(frame) AS connections, round(regularity, 6) AS regularity FROM beacon_alerts")
def _(d):
    rows = _finished(d, live.stream_beacon(_stream(d), idle_s=30 * DAY_S, **BEACON))
    return rows.select("host", "dest_ip", "dest_port", "us", "seq", "connections", F.round("regularity", 6).alias("regularity"))


# Every tenth event comes one micro-batch late, the last batch's own excepted.
ARRIVAL = "least(part + CASE WHEN seq % 10 = 3 THEN 1 ELSE 0 END, 5)"


@query("drop_late_in_channel", f"""SELECT host, process, dest_ip, dest_port, us, seq, newest AS newest_us FROM (
    SELECT *, max(us) OVER (PARTITION BY host, process, dest_ip, dest_port ORDER BY b, us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM (
        SELECT *, {ARRIVAL} AS b FROM (SELECT *, (us - (SELECT min(us) FROM tele)) // (SELECT (max(us) - min(us)) // 6 + 1 FROM tele) AS part FROM conn))) WHERE newest > us""")
def _(d):
    lo, hi = d.events.agg(F.min(us("timestamp")), F.max(us("timestamp"))).first()
    batch = F.expr(ARRIVAL.replace("part", f"((unix_micros(timestamp) - {lo or 0}L) div {((hi or 0) - (lo or 0)) // BATCHES + 1}L)"))
    return _finished(d, live.late_in_channel(_stream(d, batch=batch.cast("int")), watermark="400 days"))


# Root of a process as known at an event: the topmost ancestor among the processes seen until then.
LIVE_DISCOVERY = {
    "node_seq": "SELECT host, guid, min(seq) AS first_seq, arg_min(parent, seq) AS parent FROM tele GROUP BY host, guid",
    "asked": "SELECT DISTINCT r.seq AS s, r.host, w.guid FROM recon r JOIN recon w ON w.host = r.host AND w.root = r.root AND w.us >= r.us - 1800000000 AND w.seq <= r.seq",
    "climb": """SELECT s, host, guid, guid AS cur, 0 AS depth FROM asked UNION ALL SELECT c.s, c.host, c.guid, n.parent, c.depth + 1 FROM climb c
        JOIN node_seq n ON n.host = c.host AND n.guid = c.cur JOIN node_seq p ON p.host = c.host AND p.guid = n.parent AND p.first_seq <= c.s""",
    "known_root": "SELECT s, host, guid, arg_max(cur, depth) AS top FROM climb GROUP BY s, host, guid",
    "live_pair": """SELECT r.host, r.root, r.seq, r.us, r.guid, a.top, w.seq AS wseq, w.us AS wus, w.technique FROM recon r JOIN recon w ON w.host = r.host AND w.root = r.root AND w.us >= r.us - 1800000000 AND w.seq <= r.seq
        JOIN known_root a ON a.s = r.seq AND a.host = r.host AND a.guid = r.guid JOIN known_root b ON b.s = r.seq AND b.host = w.host AND b.guid = w.guid AND b.top = a.top""",
    "live_cand": "SELECT host, root, seq, us, top, count(DISTINCT technique) AS kinds FROM live_pair GROUP BY host, root, seq, us, top HAVING count(DISTINCT technique) >= 2",
    "live_conf": """SELECT c.*, row_number() OVER (PARTITION BY c.host, c.root ORDER BY c.us, c.seq) AS n, coalesce(b.before, []) AS before FROM live_cand c LEFT JOIN (
        SELECT p.host, p.seq, list(DISTINCT p.wseq) AS before FROM live_pair p JOIN live_cand k ON k.host = p.host AND k.seq = p.wseq WHERE p.wseq < p.seq AND p.us - p.wus < 600000000 GROUP BY p.host, p.seq) b ON b.host = c.host AND b.seq = c.seq""",
    "live_kept": """SELECT host, root, 0::BIGINT AS n, []::BIGINT[] AS kept FROM live_conf WHERE n = 1 UNION ALL
        SELECT k.host, k.root, c.n, CASE WHEN list_has_any(k.kept, c.before) THEN k.kept ELSE list_append(k.kept, c.seq) END FROM live_kept k JOIN live_conf c ON c.host = k.host AND c.root = k.root AND c.n = k.n + 1""",
}


@query("stream_discovery", """SELECT c.host, c.top AS root_guid, c.us, c.seq, c.kinds AS distinct_items FROM live_conf c
    JOIN (SELECT host, root, arg_max(kept, n) AS kept FROM live_kept GROUP BY host, root) k ON k.host = c.host AND k.root = c.root AND list_contains(k.kept, c.seq)""", **LIVE_DISCOVERY)
def _(d):
    rows = forest.stream_discovery(_stream(d), ttl_s=30 * DAY_S, **DISCOVERY)
    return _finished(d, rows).select("host", "root_guid", "us", "seq", "distinct_items")


# A life ends with a pause over ten minutes, and is told once the watermark is past the last minute's timer.
LIFE_S = 600


@query("prune_idle_state", f"""SELECT host, guid, first_us, last_us FROM (
    SELECT host, guid, min(us) AS first_us, max(us) AS last_us, lead(min(us)) OVER (PARTITION BY host, guid ORDER BY min(us)) AS born FROM (
        SELECT *, sum(CASE WHEN prev IS NULL OR us - prev > {LIFE_S}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY host, guid ORDER BY us, seq) AS life
        FROM (SELECT *, lag(us) OVER (PARTITION BY host, guid ORDER BY us, seq) AS prev FROM tele)) GROUP BY host, guid, life)
    WHERE born IS NOT NULL OR (last_us // {LIFE_S * 62500} + 1) * {LIFE_S * 62500} + {LIFE_S}000000 <= (SELECT (max(us) // 1000) * 1000 FROM tele) - 600000000""")
def _(d):
    return _finished(d, forest.ended_processes(_stream(d), ttl_s=LIFE_S, window_s=300, cooldown_s=300))


@query("stream_scan", "SELECT host, process, guid, us, seq, ips AS distinct_ips, ports AS distinct_ports FROM scan_alerts")
def _(d):
    return _finished(d, live.stream_scan(_stream(d), **SCAN))


@query("expire_window_entries", """SELECT s.host, s.process, s.guid, s.dest_ip, s.dest_port, s.us, min(c.seq) AS seq FROM (
    SELECT host, process, guid, dest_ip, dest_port, max(us) AS us FROM (
        SELECT *, sum(CASE WHEN prev IS NULL OR us - prev > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY host, process, guid, dest_ip, dest_port ORDER BY us, seq) AS life
        FROM (SELECT *, lag(us) OVER (PARTITION BY host, process, guid, dest_ip, dest_port ORDER BY us, seq) AS prev FROM conn)) GROUP BY host, process, guid, dest_ip, dest_port, life) s
    JOIN conn c ON c.host = s.host AND c.process = s.process AND c.guid = s.guid AND c.us > s.us + 600000000 GROUP BY ALL""")
def _(d):
    # State outlives the pauses of the sparse events: an entry leaves only when its process goes on.
    return _finished(d, live.expired_destinations(_stream(d), window_s=600, cooldown_s=30 * DAY_S))


@query("stream_incidents", """SELECT id, CASE WHEN last_us + 600000000 <= (SELECT (max(us) // 1000) * 1000 FROM det) - 600000000 THEN 'closed' ELSE 'open' END AS status, score, severity, detection_count, actionable,
    array_to_string(rule_ids, ',') AS rules, array_to_string(techniques, ',') AS techniques, array_to_string(chain, '>') AS chain, root_image, classification, title, first_us, last_us FROM inc""", det="SELECT * FROM rdet")
def _(d):
    # Written once: every micro-batch reads the chains.
    chains = checkpointed(tree.process_chain(d.plan.paths))
    rooted = inc.attach_tree(flow.stream_match_rules(_stream(d), d.plan.rules), chains)
    rows = flow.current_incidents(_finished(d, stream_incidents(rooted), mode="update"))
    return rows.select("id", "status", "score", "severity", "detection_count", "actionable", joined("rule_ids").alias("rules"), joined("techniques").alias("techniques"),
                       joined("chain", ">").alias("chain"), "root_image", "classification", "title", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"))
