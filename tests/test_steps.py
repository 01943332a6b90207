"""Steps that many queries share: state calls of a key, sessions read off cells, rows that are written once."""

import random
from collections import Counter

from pyspark.sql import Row, functions as F

from emberwatch.operators import detectors, ordering
from emberwatch.plans.detection import Detection
from emberwatch.streaming import state
from emberwatch.streaming.detectors import ScanFold


class Kept:
    """One key's state as the JVM would hold it, with a count of the calls."""

    def __init__(self):
        self.calls, self.value, self.maps, self.timers = Counter(), None, {}, set()

    def getValueState(self, name, schema):  # noqa: N802
        kept = self

        class Value:
            def exists(self):
                kept.calls["value"] += 1
                return kept.value is not None

            def get(self):
                kept.calls["value"] += 1
                return kept.value

            def update(self, value):
                kept.calls["value"] += 1
                kept.value = value

            def clear(self):
                kept.calls["value"] += 1
                kept.value = None
        return Value()

    def getMapState(self, name, key, value):  # noqa: N802
        kept, held = self, self.maps.setdefault(name, {})

        class Map:
            def getValue(self, key):  # noqa: N802
                kept.calls["map"] += 1
                return held.get(key)

            def containsKey(self, key):  # noqa: N802
                kept.calls["map"] += 1
                return key in held

            def updateValue(self, key, value):  # noqa: N802
                kept.calls["map"] += 1
                held[key] = value

            def removeKey(self, key):  # noqa: N802
                kept.calls["map"] += 1
                held.pop(key, None)

            def clear(self):
                kept.calls["map"] += 1
                held.clear()
        return Map()

    def registerTimer(self, at):  # noqa: N802
        self.calls["timer"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls["timer"] += 1
        self.timers.discard(at)


def scanned(batches, held_entries, monkeypatch):
    monkeypatch.setattr(state, "HELD_ENTRIES", held_entries)
    fold, kept = ScanFold(["host", "process", "guid"], 60, 0, 3, 100), Kept()
    fold.init(kept)
    out = [tuple(r) for rows in batches for r in fold.handleInputRows(("h", "p", "g"), iter(rows), None)]
    return fold, kept, out


def sightings(seed, n):
    rng = random.Random(seed)
    return [Row(us=rng.randrange(400) * state.SECOND, seq=i, dest_ip=f"1.1.1.{rng.randrange(9)}", dest_port=str(rng.randrange(3)))
            for i in range(n)]


def test_a_small_key_costs_three_calls_and_two_to_let_go(monkeypatch):
    fold, kept, _ = scanned([sightings(1, 3)], 64, monkeypatch)
    assert kept.calls == {"value": 2, "timer": 1}
    assert not any(kept.maps.values())
    kept.calls.clear()
    list(fold.handleExpiredTimer(("h", "p", "g"), None, None))
    assert kept.value is None and kept.calls == {"value": 2}


def test_entries_in_the_value_or_in_maps_give_the_same_rows(monkeypatch):
    batches = [sightings(s, n) for s, n in enumerate((1, 5, 40, 3, 80, 2))]
    _, kept, want = scanned(batches, 10_000, monkeypatch)
    assert {r[3] for r in want} == {"alert", "expired"} and not any(kept.maps.values())
    for most in (0, 4, 12):
        fold, spilled, got = scanned(batches, most, monkeypatch)
        assert got == want and spilled.maps["live"]
        list(fold.handleExpiredTimer(("h", "p", "g"), None, None))
        assert spilled.value is None and not any(spilled.maps.values())


def test_spans_are_those_of_the_sessions(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice([None, *range(0, 9000, 7)]), rng.choice([None, *range(50)])) for _ in range(800)]
    rows.append((None, 1, 1))
    frame = spark.createDataFrame(rows, "k string, us bigint, seq bigint")
    want = ordering.gap_sessions(frame, ["k"], "us", 20).groupBy("k", "session_start").agg(
        F.min(F.when(F.col("us") == F.col("session_start"), F.col("seq"))), F.max("us"))
    got = ordering.session_spans(frame, ["k"], "us", "seq", 20)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_connections_are_read_off_the_events_once(spark, monkeypatch):
    from emberwatch.plans import telemetry
    events = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i % 9, "signup", 1.0, '{"k": 3}') for i in range(120)]
    folder = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double, props string")
    taken, plain = [], detectors.connections
    monkeypatch.setattr(detectors, "connections", lambda *a: taken.append(a) or plain(*a))
    monkeypatch.setattr(telemetry, "load_table", lambda *a: folder)
    plan = Detection(telemetry.telemetry(spark, ""))
    plan.detections
    assert len(taken) == 1


def test_numbered_connections_are_not_written_again(make_events, monkeypatch):
    """The plan writes its connections with their numbers; a detector that is given them writes times alone."""
    written, plain = [], detectors.checkpointed
    monkeypatch.setattr(detectors, "checkpointed", lambda df: written.append("raw" in df.columns) or plain(df))
    events = make_events([{"event_id": 3, "at": 60 * i, "image": "a.exe", "DestinationIp": "1.1.1.1", "DestinationPort": "443"}
                          for i in range(8)])
    plan = Detection(events, settings={"beacon": {}})
    got = plan.detections.filter("source = 1").select("seq", "title").collect()
    assert sum(written) == 1
    want = detectors.beacon_detect(events, conns=detectors.connections(events)).select("seq", "title").collect()
    assert sorted(got) == sorted(want) and got
