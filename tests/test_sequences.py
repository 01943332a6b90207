import random

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import detectors as det, ordering
from emberwatch.operators.ordering import active_breadth, cooldown_filter, gap_sessions, previous_time, trailing_frames

random.seed(7)
ROWS = [(random.choice("aaab"), random.randint(0, 60_000), i) for i in range(1200)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k string, us bigint, seq bigint").cache()


def by_key(k):
    return sorted((u, s) for kk, u, s in ROWS if kk == k)


@pytest.mark.parametrize("cooldown", [1, 2, 70, 4000, 100_000])
def test_cooldown_is_greedy(rows, cooldown):
    want = set()
    for k in "ab":
        last = None
        for u, s in by_key(k):
            if last is None or u - last >= cooldown:
                want.add((k, u, s))
                last = u
    assert {tuple(r) for r in cooldown_filter(rows, ["k"], "us", "seq", cooldown).collect()} == want


def test_no_cooldown_keeps_all_and_a_negative_one_is_refused(rows):
    assert cooldown_filter(rows, ["k"], "us", "seq", 0).count() == len(ROWS)
    with pytest.raises(ValueError):
        cooldown_filter(rows, ["k"], "us", "seq", -1)


def test_cooldown_of_one_busy_key(spark):
    """A million candidates of one key: all kept, and in one piece without a pause."""
    far = spark.range(1_000_000).selectExpr("'k' as k", "id * 10 as us", "id as seq")
    assert cooldown_filter(far, ["k"], "us", "seq", 10).count() == 1_000_000
    assert cooldown_filter(far, ["k"], "us", "seq", 25).count() == 333_334


def test_gap_boundary_is_inclusive(spark):
    df = spark.createDataFrame([("a", 0), ("a", 600), ("a", 1201), ("a", -5)], "k string, us bigint")
    got = {r.us: r.session_start for r in gap_sessions(df, ["k"], "us", 600).collect()}
    assert got == {-5: -5, 0: -5, 600: -5, 1201: 1201}


def test_breadth_counts_live_items(rows):
    got = active_breadth(rows.withColumn("item", F.col("seq") % 11), ["k"], {"n": "item"}, "us", "seq", 400, cell_us=1500).collect()
    assert len(got) == len(ROWS)
    for r in got[::7]:
        live = {s % 11 for u, s in by_key(r.k) if r.us - 400 <= u and (u, s) <= (r.us, r.seq)}
        assert r.n == len(live)


def test_frames_cross_cells_and_chunks(rows):
    for r in trailing_frames(rows, ["k"], "us", "seq", 6, cell_us=900, chunk=9).collect()[::5]:
        before = [x for x in by_key(r.k) if x <= (r.us, r.seq)]
        assert list(r.frame) == [u for u, _ in before[-6:]]


def test_previous_time(rows):
    for r in previous_time(rows, ["k"], "us", ["seq"], cell_us=50).collect()[::9]:
        before = [x for x in by_key(r.k) if x < (r.us, r.seq)]
        assert r.previous_us == (before[-1][0] if before else None)


def net(at, ip="8.8.8.8", port="443", **kw):
    return dict(event_id=3, at=at, image=r"C:\t\imp.exe", process_guid="p", DestinationIp=ip, DestinationPort=port, **kw)


def test_beacon_needs_rhythm_and_count(make_events):
    steady = [net(60 * i) for i in range(8)]
    ragged = [net(t, ip="9.9.9.9") for t in (0, 5, 200, 210, 900, 1500, 1501, 4000)]
    quiet = [dict(net(60 * i, ip="1.1.1.1"), image=r"C:\p\chrome.exe") for i in range(8)]
    found = det.beacon_detect(make_events(steady + ragged + quiet)).collect()
    assert [(r.severity, r.evidence["destination"], r.evidence["connections"]) for r in found] == [("critical", "8.8.8.8:443", "6")]
    assert found[0].title == "Periodic outbound connection: imp.exe to 8.8.8.8:443 every ~60s"


def test_scan_shapes(make_events):
    sweep = det.scan_detect(make_events([net(i, ip=f"8.8.4.{i}") for i in range(12)])).first()
    assert sweep.title.startswith("Network host sweep: imp.exe reached 10 distinct host(s)") and sweep.attack == ["T1046", "T1018"]
    ports = det.scan_detect(make_events([net(i, port=str(i)) for i in range(20)])).first()
    assert ports.title.startswith("Network port scan") and ports.attack == ["T1046"]
    assert det.scan_detect(make_events([net(400 * i, ip=f"8.8.4.{i}") for i in range(12)])).count() == 0


def test_discovery_burst(spark, make_events):
    lines = ["whoami", "net user", "ipconfig", "whoami", "systeminfo", "tasklist"]
    events = make_events([dict(at=10 * i, process_guid="p", command_line=c) for i, c in enumerate(lines)])
    roots = spark.createDataFrame([("H", "p", "r", 0)], "host string, guid string, root_guid string, depth int")
    found = det.discovery_burst(events, roots).collect()
    assert len(found) == 1 and found[0].severity == "medium" and found[0].command_line is None
    assert found[0].attack == ["T1016", "T1033", "T1082", "T1087"]
    assert found[0].title == "Reconnaissance burst: 4 distinct discovery techniques in 40s"
    assert found[0].evidence["commands"] == '["whoami","net user","ipconfig","systeminfo"]'


def test_group_query_is_permission_discovery(spark):
    df = spark.createDataFrame([('net group "domain admins" /domain',), ("dsquery computer",), ("dir",)], "c string")
    got = [r[0] and r[0].technique for r in df.select(det.discovery_classify(F.col("c"))).collect()]
    assert got == ["T1069", "T1087", None]


@pytest.fixture(scope="module")
def crowd(spark):
    """One key, all in one hour: half of the rows at one microsecond, so that only their seq orders them."""
    data = [("a", 500 if i % 2 else random.randint(0, 2000), i, i % 13) for i in range(1500)] + [("b", 1, 0, 0)]
    random.shuffle(data)
    return data, spark.createDataFrame(data, "k string, us bigint, seq bigint, item bigint")


def test_a_crowded_hour_is_cut_into_pieces(crowd):
    _, frame = crowd
    pieces = ordering._pieces(frame, ["k"], "us", ["seq"], ordering.HOUR_US, 200)
    sizes = {tuple(r)[:2]: r["count"] for r in pieces.groupBy("k", "_piece").count().collect()}
    assert len(sizes) > 8 and max(sizes.values()) < 300 and sum(sizes.values()) == 1501
    spans = pieces.filter("k = 'a'").groupBy("_piece").agg(F.min(F.struct("us", "seq")), F.max(F.struct("us", "seq"))).orderBy("_piece").collect()
    assert all(before[2] < after[1] for before, after in zip(spans, spans[1:]))


def test_order_holds_across_pieces(crowd):
    data, frame = crowd
    order = sorted((u, s, item) for k, u, s, item in data if k == "a")
    at = {s: i for i, (_, s, _) in enumerate(order)}
    previous = previous_time(frame, ["k"], "us", ["seq"], piece_rows=200).filter("k = 'a'").collect()
    frames = trailing_frames(frame, ["k"], "us", "seq", 7, piece_rows=200, chunk=90).filter("k = 'a'").collect()
    breadth = active_breadth(frame, ["k"], {"n": "item"}, "us", "seq", 30, piece_rows=200).filter("k = 'a'").collect()
    assert len(previous) == len(frames) == len(breadth) == 1500
    for p, f, n in zip(previous, frames, breadth):
        assert p.previous_us == (order[at[p.seq] - 1][0] if at[p.seq] else None)
        assert list(f.frame) == [u for u, _, _ in order[max(0, at[f.seq] - 6):at[f.seq] + 1]]
        assert n.n == len({item for u, _, item in order[:at[n.seq] + 1] if u >= n.us - 30})
