import itertools
import json
import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from emberwatch.functions import scalars as sc
from emberwatch.operators import evidence, exports, search, similarity, tree
from emberwatch.operators.matching import Rule
from emberwatch.operators.normalize import normalize_events
from emberwatch.plans.detection import Detection
from emberwatch.sources.events import evtx_json_to_payload, intake_split, lift_text_nodes
from emberwatch.sources.tables import triage_overlay, triage_refused

SHAPES = "id string, root_image string, chain array<string>, techniques array<string>, rule_ids array<string>, last_seen int"
NODES = "host string, guid string, parent_guid string, image string, command_line string, first_seen timestamp, last_seen timestamp, name string"
ANY = [Rule("R1", 1, "medium", "one", {"command_line|contains": "x"}, ("T1059",)), Rule("R2", 1, "critical", "two", {"command_line|contains": "y"}, ("T1003.001",))]


def node_frame(spark, links):
    return spark.createDataFrame([("H", g, p, None, None, None, None, g) for g, p in links], NODES)


def test_ancestry_stops_at_unknown_cycle_and_depth(spark):
    deep = [(f"n{i}", f"n{i - 1}") for i in range(1, 40)] + [("n0", None)]
    links = [("a", "ghost"), ("b", "a"), ("x", "y"), ("y", "x"), ("s", "s")] + deep
    got = {r.guid: r.path for r in tree.ancestry(node_frame(spark, links)).collect()}
    assert got["b"] == ["a", "b"] and got["a"] == ["a"] and got["s"] == ["s"]
    assert got["x"] == ["y", "x"] and got["y"] == ["x", "y"]
    assert got["n5"] == [f"n{i}" for i in range(6)]
    assert got["n39"] == [f"n{i}" for i in range(40)]
    near = {r.guid: r.path for r in tree.ancestry(node_frame(spark, links), max_depth=24).collect()}
    assert near["n39"] == [f"n{i}" for i in range(16, 40)] and near["x"] == ["y", "x"] and near["b"] == ["a", "b"]


def test_subtree_has_no_depth_limit_and_survives_cycles(spark):
    links = [(f"n{i}", f"n{i - 1}") for i in range(1, 30)] + [("n0", None), ("x", "y"), ("y", "x"), ("k", "ghost")]
    roots = spark.createDataFrame([("H", "n0"), ("H", "x"), ("H", "ghost")], "host string, root_guid string")
    got = {}
    for r in tree.subtree(node_frame(spark, links), roots).collect():
        got.setdefault(r.root_guid, set()).add(r.guid)
    assert got == {"n0": {f"n{i}" for i in range(30)}, "x": {"x", "y"}, "ghost": {"k"}}


def test_nodes_take_first_non_empty_values(make_events):
    rows = make_events([dict(process_guid="p", image="", at=9), dict(process_guid="p", image="C:\\a.exe", parent_process_guid="q", at=3)])
    node = tree.process_nodes(rows).first()
    assert (node.name, node.parent_guid) == ("a.exe", "q") and node.first_seen == node.last_seen


def test_incident_gap_score_and_orphans(make_events):
    events = make_events([
        dict(at=0, process_guid="p", command_line="x", image="C:\\a.exe"), dict(at=600, process_guid="p", command_line="x"),
        dict(at=1201, process_guid="p", command_line="xy"), dict(at=5, command_line="x", image="C:\\b.exe", parent_image="C:\\c.exe")])
    rows = {r.id.rsplit("/", 1)[0] + str(i): r for i, r in enumerate(Detection(events, ANY, {}).incidents.orderBy("root_guid", "first_seen").collect())}
    orphan, first, second = rows["H/orphan:H:R10"], rows["H/p1"], rows["H/p2"]
    assert (orphan.chain, orphan.root_image, orphan.actionable) == (["c.exe", "b.exe"], "C:\\c.exe", False)
    assert (first.score, first.severity, first.detection_count, first.actionable) == (10, "high", 2, False)
    assert (second.score, second.severity, second.actionable, second.techniques) == (19, "critical", True, ["T1003.001", "T1059"])
    assert second.title == "Credential access on H"


def test_search_levels(make_events):
    events = make_events([dict(process_guid="p", command_line="x", image="C:\\w3wp.exe", User="bob"), dict(at=9000, process_guid="q", command_line="y", image="C:\\z.exe")])
    plan = Detection(events, ANY, {})
    find = lambda **kw: sorted((r.incident_id.split("/")[1], r.match_count) for r in search.search_incidents(plan.incidents, plan.members, **kw).collect())
    assert find() == []
    assert find(terms=["w3wp"]) == [("p", 1)]
    assert find(filters={"host": "h"}) == [("p", 1), ("q", 1)]
    assert find(filters={"technique": "t1003"}) == [("q", 1)]
    assert find(terms=["credential"]) == [("q", 0)]
    assert find(filters={"user": "bob", "severity": "critical"}) == []


def likeness(a, b):
    jac = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if set(x) | set(y) else 0.0
    parts = [(0.5, jac(a[4], b[4]))] if a[4] is not None and b[4] else []
    parts += [(0.2, jac(a[3], b[3])), (0.2, float(a[1] != "" and a[1] == b[1])), (0.1, jac(a[2], b[2]))]
    return sum(w * v for w, v in parts) / sum(w for w, _ in parts)


@pytest.mark.parametrize("threshold", [0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9])
def test_noise_join_finds_what_all_pairs_find(spark, threshold):
    random.seed(3)
    pick = lambda pool, n: sorted(random.sample(pool, random.randint(0, n)))
    rows = [(f"i{i}", random.choice(["", "a", "b"]), pick(["a", "b", "c"], 3), pick(["T1", "T2", "T3"], 3),
             None if i % 5 == 0 else pick(["R1", "R2", "R3", "R4"], 4), i) for i in range(90)]
    frame = similarity.with_digest(spark.createDataFrame(rows, SHAPES))
    names = {r.fp: r.id for r in frame.collect()}
    pairs = similarity.noise_join(frame.filter("last_seen < 45"), frame.filter("last_seen >= 45"), threshold=threshold)
    by_id = {r[0]: r for r in rows}
    got = {(r.fp, r.matched_fp) for r in pairs.collect()}
    prints = {r.id: r.fp for r in frame.collect()}
    sure, possible = ({(prints[a[0]], prints[b[0]]) for a, b in itertools.product(rows[:45], rows[45:]) if likeness(a, b) >= threshold + e}
                      for e in (1e-9, -1e-9))
    assert sure <= got <= possible and sure
    assert len(by_id) == 90 and len(names) <= 90


def test_the_oldest_of_many_false_positives_can_be_the_best_match(spark):
    past = [(f"p{i}", "r", ["a"], ["T1"], ["R1", f"X{i}", f"Y{i}"], 1000 + i) for i in range(700)] + [("old", "r", ["a"], ["T1"], ["R1", "R2"], 1)]
    open_ = similarity.with_digest(spark.createDataFrame([("o", "r", ["a"], ["T1"], ["R1", "R2"], 9999)], SHAPES))
    history = similarity.with_digest(spark.createDataFrame(past, SHAPES))
    top = similarity.noise_top3(open_, history, similarity.noise_join(open_, history)).orderBy("rank").collect()
    assert [(r.matched_id, r.score) for r in top] == [("old", 1.0), ("p699", 0.63), ("p698", 0.63)]


def test_likeness_over_blocks_gives_the_same_best_matches_and_shuffles_no_pairs(spark):
    random.seed(5)
    pick = lambda pool, n: random.sample(pool, random.randint(0, n))
    rows = [(f"i{i}", random.choice([None, "", "a", "b"]), pick(["a", "b", "c"], 3), None if i % 11 == 0 else pick(["T1", "T2", "T3"], 3),
             None if i % 5 == 0 else pick(["R1", "R2", "R3", "R4"], 4), i // 3) for i in range(240)]
    rows += [(f"w{i}", "a", [f"c{k}" for k in range(2500)], ["T1"], [f"R{k}" for k in range(i, 2400)], i) for i in (0, 1)]
    frame = similarity.with_digest(spark.createDataFrame(rows, SHAPES))
    open_, history = frame.filter("int(substr(id, 2)) % 2 = 0"), frame.filter("int(substr(id, 2)) % 2 = 1")
    pairs = similarity.noise_join(open_, history, block=48)
    measured = similarity.noise_similarity()
    plain = open_.dropDuplicates(["fp"]).alias("a").crossJoin(history.dropDuplicates(["fp"]).alias("b")).select(
        "a.fp", F.col("b.fp").alias("matched_fp"), measured["score"].alias("score"), measured["matched_on"].alias("matched_on")).filter("score >= 0.6")
    as_set = lambda df: sorted((r.fp, r.matched_fp, r.score, tuple(r.matched_on)) for r in df.collect())
    assert as_set(pairs) == as_set(plain) and pairs.count() > 500
    # Nothing that holds pairs is exchanged or sorted.
    above = pairs._jdf.queryExecution().sparkPlan().toString().split("FlatMapGroups")[0]
    assert "Exchange" not in above and "Join" not in above
    ranked = lambda p: sorted(tuple(r) for r in similarity.noise_top3(open_, history, p).collect())
    few = similarity.noise_join(open_, history, block=64, best=3)
    assert few.count() < pairs.count() and ranked(few) == ranked(pairs)


def test_triage_overlay_defaults_and_limits(spark):
    incidents = spark.createDataFrame([("a",), ("b",)], "id string")
    log = spark.createDataFrame([("a", 1, 1, "Closed", "n"), ("a", 2, 2, "bogus", "w " * 501)],
                                "incident_id string, changed_at int, seq int, status string, notes string")
    got = {r.id: (r.status, r.notes) for r in triage_overlay(incidents, log).collect()}
    assert got == {"a": ("closed", "n"), "b": ("open", "")}
    more = log.unionByName(spark.createDataFrame([("b", 3, 3, None, "w " * 500), ("b", 4, 4, "open", "w " * 501)], log.schema))
    assert [(r.seq, r.refused) for r in triage_refused(more).orderBy("seq").collect()] == [(2, ["status", "notes"]), (4, ["notes"])]


def test_normalize_shapes(spark):
    payloads = [
        {"@timestamp": "2026-07-12T10:00:00Z", "winlog": {"event_id": "1", "computer_name": "W", "event_data": {"Image": "a", "ProcessId": "7"}}},
        {"event_id": 3, "host": {"name": "N"}, "event_data": {"SourceImage": "s", "Image": "a", "ProcessId": "x"}},
        {"EventID": 22, "QueryName": "q", "Computer": "C"}, {"EventID": 1, "Image": "a", "Computer": "C", "UtcTime": "2026-07-12 10:00:00"},
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "seq long, value string").withColumn("received_at", F.lit("2000-01-01").cast("timestamp"))
    w, n, q, f = normalize_events(df).orderBy("seq").collect()
    assert (w.event_id, w.host, w.process_id, w.timestamp.year) == (1, "W", 7, 2026)
    assert (n.event_id, n.host, n.image, n.process_id, n.timestamp.year) == (3, "N", "s", None, 2000)
    assert (q.event_id, q.host, q.raw) == (22, "unknown", {})
    assert (f.host, f.image, f.timestamp.year, f.raw["EventID"]) == ("C", "a", 2026, "1")


def test_intake(spark):
    df = spark.createDataFrame([("{}",), ("[1]",), ("x{",), ("null",), ('{"a":"' + "y" * 50 + '"}',)], "value string")
    assert [r.outcome for r in intake_split(df, max_bytes=40).collect()] == ["accepted", "malformed", "malformed", "malformed", "oversize"]


def test_indicator_kinds(spark):
    values = ["8.8.8.8", "10.0.0.1", "2606:4700::1111", "fe80::1", "203.0.113.9", "a" * 32, "evil.example.com", "a/b.c", "plain", "300.1.1.1"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(sc.classify_indicator(F.col("v"))).collect()]
    assert got == ["ip", None, "ip", None, None, "hash", "domain", None, None, "domain"]


def test_stix_report_splits_only_when_long(make_events):
    events = make_events([dict(at=i, process_guid="p", command_line="x", event_id=1, DestinationIp=f"8.8.8.{i}") for i in range(7)])
    plan = Detection(events, ANY, {})
    summaries = evidence.behavior_profile(plan.incidents, evidence.behavior_phases(plan.members))
    build = lambda n: [json.loads(r.object) for r in exports.stix_objects(plan.incidents, evidence.indicators(plan.members), summaries, refs_per_report=n).collect()]
    one, many = build(1000), build(3)
    reports = lambda objects: [o for o in objects if o["type"] == "report"]
    ids = {o["id"] for o in one if o["type"] != "report"}
    assert len(reports(one)) == 1 and set(reports(one)[0]["object_refs"]) == ids and len(ids) == 9
    assert len(reports(many)) == 3 and {x for r in reports(many) for x in r["object_refs"]} == ids
    assert reports(one)[0]["id"] in {r["id"] for r in reports(many)}


def test_stix_bundles_are_documents(make_events, tmp_path):
    events = make_events([dict(at=i, host=f"h{i % 2}", process_guid=f"p{i % 2}", command_line="x \\ }", event_id=1, DestinationIp=f"8.8.8.{i}")
                          for i in range(9)])
    plan = Detection(events, ANY, {})
    summaries = evidence.behavior_profile(plan.incidents, evidence.behavior_phases(plan.members))
    args = plan.incidents, evidence.indicators(plan.members), summaries
    exports.write_stix_bundles(exports.stix_bundle_lines(*args), str(tmp_path / "out"))
    rows = exports.stix_objects(*args).collect()
    folders = list((tmp_path / "out").glob("incident_id=*"))
    assert len(folders) == len({r.incident_id for r in rows} - {None}) > 0
    for folder in folders:
        bundle = json.loads("".join(f.read_text() for f in sorted(folder.glob("part-*"))))
        incident = unquote(folder.name.split("=", 1)[1])  # Spark escapes names of folders
        want = {r.id: json.loads(r.object) for r in rows if r.incident_id in (incident, None)}
        got = {o["id"]: o for o in bundle["objects"]}
        assert bundle["type"] == "bundle" and bundle["id"].startswith("bundle--") and len(got) == len(bundle["objects"])
        report = next(o for o in bundle["objects"] if o["type"] == "report")
        assert got == want and set(report["object_refs"]) == got.keys() - {report["id"]}


def test_scores_round_by_their_exact_value(spark):
    values = [i / 1000 for i in range(0, 1001)] + [0.8250000000000001, 0.625, 0.875]
    df = spark.createDataFrame([(v,) for v in values if v >= 0.01], "v double")
    assert all(r[1] == round(r[0], 2) for r in df.select("v", sc.round_exact(F.col("v"), 2)).collect())


def test_other_roundings_are_exact_too(spark):
    values = [62.25, 62.35, 0.05, 0.15, 1234.5, 0.0, 863_999.95, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(sc.round_exact(F.col("v"), 1)).collect()] == [round(v, 1) for v in values]


def test_fallback_chain_is_the_opening_detections(make_events):
    chain = lambda *rows: Detection(make_events(list(rows)), ANY, {}).incidents.first().chain
    first = dict(at=0, command_line="x", image="C:\\a.exe")
    assert chain(first, dict(at=5, command_line="x", image="C:\\b.exe", parent_image="C:\\p.exe")) == ["a.exe"]
    tree_rows = [dict(at=0, process_guid="r", image="C:\\r.exe", command_line="x"),
                 dict(at=5, process_guid="c", parent_process_guid="r", image="C:\\c.exe", command_line="x")]
    assert chain(*tree_rows) == ["r.exe", "c.exe"]


def test_text_nodes_are_lifted_once(spark):
    cases = {'{"a":{"#text":[1,2]}}': '{"a":[1,2]}', '{"#text":{"#text":1}}': '{"#text":1}', '[{"#text":"x"},{"b":{"#text":null}}]': '["x",{"b":null}]',
             '{"a":{"#text":1,"k":2}}': '{"a":{"#text":1,"k":2}}', "broken{": "broken{", '{"t":"{\\"#text\\":1}"}': '{"t":"{\\"#text\\":1}"}'}
    df = spark.createDataFrame(list(cases.items()) + [(None, None)], "source string, want string")
    assert all(r[0] == r[1] for r in df.select(lift_text_nodes(F.col("source")), "want").collect())


def test_hostile_records_do_not_end_an_intake(spark):
    hostile = ["[" * 100_000, '{"#text":"\\ud800"}', '{"a":1e999}', '{"a":1,"a":2}', '{"a":1.10}', "null", ""]
    df = spark.createDataFrame([(s,) for s in hostile], "value string")
    got = [r[0] for r in df.select(lift_text_nodes(F.col("value"))).collect()]
    assert [got[i] for i in (0, 3, 5, 6)] == [hostile[i] for i in (0, 3, 5, 6)]
    assert json.loads(got[1]) == "?" and json.loads(got[4]) == {"a": 1.1}
    record = '{"Event":{"System":{"EventID":1,"Computer":"h"},"EventData":{"Image":{"#text":%s},"More":[{"#text":"x"}]}}}'
    values = [record % v for v in ('"a"', '"\\ud800"', "1e999", "[" * 50_000)] + ["[]", '{"Event":7}']
    out = evtx_json_to_payload(spark.createDataFrame([(s,) for s in values], "value string")).collect()
    assert len(out) >= 3 and json.loads(out[0]["value"])["winlog"]["event_data"] == {"Image": "a", "More": ["x"]}


def test_roots_by_pointers_of_deep_chains_and_cycles(spark):
    deep = [(f"d{i}", f"d{i - 1}" if i else "unseen") for i in range(5000)]
    rng = random.Random(4)
    bushy = [(f"b{i}", f"b{rng.randrange(i)}" if i and rng.random() < 0.9 else None) for i in range(200)]
    loops = [("a", "b"), ("b", "c"), ("c", "a"), ("t1", "a"), ("t2", "t1"), ("self", "self"), ("s2", "self")]
    got = {r.guid: (r.root_guid, r.depth) for r in tree.tree_root(node_frame(spark, deep + bushy + loops)).collect()}
    parents = dict(deep + bushy + loops)
    for guid in [*parents]:
        at, seen = guid, [guid]
        while guid[0] != "d" and parents[at] in parents and parents[at] not in seen:
            at = parents[at]
            seen.append(at)
        assert got[guid] == (("d0", int(guid[1:])) if guid[0] == "d" and guid[1:].isdigit() else (at, len(seen) - 1)), guid


def test_search_hits_are_rows(spark, make_events):
    events = make_events([dict(at=0, process_guid="r", image="C:\\needle.exe", command_line="vssadmin delete shadows /all /quiet"),
                          dict(at=5, process_guid="c", parent_process_guid="r", image="C:\\c.exe", command_line="vssadmin delete shadows /all /quiet"),
                          dict(at=9, host="other", process_guid="o", image="C:\\o.exe", command_line="vssadmin delete shadows /all /quiet")])
    plan = Detection(events, settings={})
    hits = search.search_hits(plan.incidents, plan.members, terms=["needle"]).collect()
    assert {r.seq for r in hits if r.matched} == {0} and all(r.matched for r in hits)
    whole = search.search_hits(plan.incidents, plan.members, filters={"host": "oth"}).collect()
    assert {r.seq for r in whole} == {2} and all(r.matched for r in whole)
    by_title = search.search_hits(plan.incidents, plan.members, terms=["on other"]).collect()
    assert {r.seq for r in by_title} == {2} and not any(r.matched for r in by_title)
    counts = {r.incident_id: r.match_count for r in search.search_incidents(plan.incidents, plan.members, terms=["on other"]).collect()}
    assert list(counts.values()) == [0]


def test_plan_derives_its_events_once(spark, make_events):
    events = make_events([{"at": 30 * i, "process_guid": f"p{i % 3}", "parent_process_guid": "p0", "image": "a.exe",
                           "command_line": "whoami x", "event_id": 1 if i % 2 else 3, "DestinationIp": f"45.1.1.{i}"} for i in range(12)])
    derived = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def host(name):
        derived.add(1)
        return name

    plan = Detection(events.withColumn("host", host("host")), ANY, {})
    assert plan.incidents.count() > 0
    assert derived.value == 12
