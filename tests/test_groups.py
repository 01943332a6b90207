"""State of many keys in one group."""

import random

from pyspark.sql import Row, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from emberwatch.model import EVENT_SCHEMA
from emberwatch.plans import queries
from emberwatch.streaming import state
from emberwatch.streaming.detectors import ScanFold
from emberwatch.streaming.forest import ForestFold


class Jvm:
    """The state of one group, counting what would be a call to the JVM."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = None, {}, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        jvm = self

        class Value:
            def get(self):
                jvm.calls += 1
                return jvm.value

            def update(self, value):
                jvm.calls += 1
                jvm.value = value

            def clear(self):
                jvm.calls += 1
                jvm.value = None
        return Value()

    def getMapState(self, name, key, value):  # noqa: N802
        jvm = self

        class Map:
            def getValue(self, key):  # noqa: N802
                jvm.calls += 1
                return jvm.map.get(key)

            def updateValue(self, key, value):  # noqa: N802
                jvm.calls += 1
                jvm.map[key] = value

            def removeKey(self, key):  # noqa: N802
                jvm.calls += 1
                jvm.map.pop(key, None)
        return Map()

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


def grouped(fold):
    jvm, group = Jvm(), state.Grouped(fold)
    group.init(jvm)
    return group, jvm


def take(group, rows):
    return [tuple(r) for r in group.handleInputRows(0, iter(rows), None)]


def expire(group, jvm, now):
    """As the JVM does: a timer that is due calls, and goes after its call."""
    out = []
    for at in sorted(t for t in jvm.timers if t <= now):
        out += [tuple(r) for r in group.handleExpiredTimer(0, TimerValues(0, now), ExpiredTimerInfo(at))]
        jvm.timers.discard(at)
    return out


def test_pages_are_a_dictionary_that_grows(monkeypatch):
    monkeypatch.setattr(state, "PAGE_ENTRIES", 4)
    rng, jvm, want, size = random.Random(3), Jvm(), {}, (1, 0)
    kept = jvm.getMapState("pages", "", "")
    for _ in range(60):
        pages = state.Pages(kept, "o", *size)
        for _ in range(40):
            key = (rng.choice(["a", None, "ü"]), rng.randrange(200))
            value = rng.choice([None, rng.random(), (1, [2])])
            pages.put(key, value)
            want.pop(key, None) if value is None else want.update({key: value})
            probe = (rng.choice(["a", None, "ü"]), rng.randrange(200))
            assert pages.get(probe) == want.get(probe)
        pages.flush()
        size = pages.pages, pages.entries
        assert size[1] == len(want)
    assert size[0] >= len(want) // 4
    before = jvm.calls
    state.Pages(kept, "o", *size).get(("a", 7))
    assert jvm.calls == before + 1  # a look-up reads its page alone
    pages.clear()
    assert not jvm.map


def sightings(rng, keys, n, lo, hi):
    return [Row(host="h", process=None, guid=f"g{rng.randrange(keys)}", us=rng.randrange(lo, hi) * state.SECOND, seq=i,
                dest_ip=f"1.1.1.{rng.randrange(9)}", dest_port=str(rng.randrange(3))) for i in range(n)]


def test_keys_of_a_group_are_as_if_alone_and_share_their_calls():
    rng, fold = random.Random(4), lambda: ScanFold(["host", "process", "guid"], 60, 0, 3, 100)
    group, jvm = grouped(fold())
    alone = {}
    for lo in (0, 300, 4000):
        rows = sightings(rng, 300, 2000, lo, lo + 300)
        jvm.calls = 0
        got = take(group, rows)
        assert jvm.calls < 60, "before, each of 300 keys had three calls and more"
        want = []
        for guid in sorted({r.guid for r in rows}):
            one, _ = alone.setdefault(guid, grouped(fold()))
            want += take(one, [r for r in rows if r.guid == guid])
        assert sorted(got, key=str) == sorted(want, key=str) and got
        for now in (lo * 1000 + 200_000, lo * 1000 + 330_000):
            expire(group, jvm, now)
            for one, its in alone.values():
                expire(one, its, now)
            assert min(jvm.timers, default=0) == min((t for _, its in alone.values() for t in its.timers), default=0)
    expire(group, jvm, 10 ** 9)
    assert jvm.value is None and not jvm.map and not jvm.timers


def test_a_host_with_many_processes_ends_each_once():
    """A cell's list is not copied for every process that joins it; what is kept of them goes."""
    group, jvm = grouped(ForestFold(60, 60, 2, 600))
    rows = [Row(host=f"h{i % 2}", us=i * 1000, seq=i, guid=f"p{i}", parent_guid=f"p{i // 2}" if i else None, technique=None) for i in range(3000)]
    assert take(group, rows) == []
    assert len(jvm.timers) == 1
    late = [Row(host="h0", us=500 * state.SECOND, seq=5000, guid="p0", parent_guid=None, technique=None)]
    take(group, late)
    ended = expire(group, jvm, 700_000)
    assert sorted(r[4] for r in ended) == sorted(f"p{i}" for i in range(1, 3000))
    assert [r[4] for r in expire(group, jvm, 2_000_000)] == ["p0"]
    assert not jvm.timers and group.common.entries == 2  # an empty value for each host


class Source:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0

    def scratch(self):
        self.n += 1
        return f"{self.folder}/{self.n}"


def test_a_micro_batch_is_read_in_several_pieces(spark, tmp_path, monkeypatch):
    """Before, a batch was one file, so one task; batches with few rows or none have as many files as the others."""
    monkeypatch.setattr(queries, "FILE_ROWS", 10)
    counts = [200, 0, 3, 90, 1, 7]
    seqs = [(b, i) for b, n in enumerate(counts) for i in range(n)]
    rows = spark.createDataFrame([(k, b) for k, (b, _) in enumerate(seqs)], "seq long, b int")
    events = rows.select(*[F.col("seq") if f.name == "seq" else F.col("b").alias("event_id") if f.name == "event_id"
                           else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields])
    source = Source(spark, str(tmp_path))
    stream = queries._stream(source, events, batch=F.col("event_id"))
    out = queries.flow.live_push(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    out.awaitTermination()
    seen = queries.flow.published(spark, f"{tmp_path}/out", stream.schema)
    assert {(r.event_id, r.batch): r["count"] for r in seen.groupBy("event_id", "batch").count().collect()} == {
        (b, b): n for b, n in enumerate(counts) if n}
    files = [len(spark.read.parquet(f"{tmp_path}/2/{b}").inputFiles()) for b in range(queries.BATCHES)]
    assert files == [4] * 6
