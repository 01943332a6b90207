"""Statistical detectors over event sequences: beacon, discovery burst, network scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberwatch.functions.predicates import REGEX_FLAGS
from emberwatch.functions.scalars import basename, once, round_exact
from emberwatch.model import (
    BEACON_RULE, BEACON_TECHNIQUES, DETECTION_COLUMNS, DISCOVERY_RULE, DISCOVERY_SIGNATURES, EXCLUDED_IMAGES,
    NETWORK_CONNECT, PROCESS_CREATE, SCAN_RULE, SCAN_TECHNIQUE, SWEEP_TECHNIQUE, epoch_us,
)
from emberwatch.session import checkpointed
from emberwatch.operators.ordering import active_breadth, cooldown_filter, gap_sessions, previous_time, trailing_frames

SECOND = 1_000_000
CHANNEL = ["host", "process", "dest_ip", "dest_port"]


def connections(events: DataFrame, excluded: tuple[str, ...] = EXCLUDED_IMAGES) -> DataFrame:
    """Network events with a destination, image names that are expected to be noisy left out."""
    ip, port = F.col("raw")["DestinationIp"], F.col("raw")["DestinationPort"]
    return (
        events.filter((F.col("event_id") == NETWORK_CONNECT) & F.coalesce(ip != "", F.lit(False)))
        .withColumn("process", F.lower(basename(F.col("image"), "unknown")))
        .filter(~F.col("process").isin(*excluded) if excluded else F.lit(True))
        .withColumns({"dest_ip": ip, "dest_port": F.coalesce(port, F.lit("None")), "us": epoch_us(F.col("timestamp"))})
    )


def numbered(conns: DataFrame) -> DataFrame:
    """The connections written once, with `_row`, by which a detector takes up whole rows again."""
    return checkpointed(conns.withColumn("_row", F.monotonically_increasing_id()))


def channel_intervals(conns: DataFrame, keys: list[str] = CHANNEL) -> DataFrame:
    """Add `interval_s`, the seconds since the channel's previous connection."""
    return previous_time(conns, keys, "us", ["seq"]).withColumn(
        "interval_s", (F.col("us") - F.col("previous_us")) / SECOND
    ).drop("previous_us")


def trailing_64(conns: DataFrame, keys: list[str] = CHANNEL, capacity: int = 64) -> DataFrame:
    return trailing_frames(conns, keys, "us", "seq", capacity)


def _median_sorted(values: Column) -> Column:
    """Median of a sorted array: the middle value, or the mean of the middle pair."""
    n = F.size(values)
    at = lambda i: F.get(values, i.cast("int"))
    return (at(F.floor((n - 1) / F.lit(2))) + at(F.floor(n / F.lit(2)))) / 2


def frame_intervals(frame: Column) -> Column:
    """Sorted gaps, in microseconds, between successive times of a frame."""
    return F.sort_array(F.transform(
        F.slice(frame, F.lit(2), F.greatest(F.size(frame) - 1, F.lit(0))), lambda t, i: t - F.get(frame, i)
    ))


def regularity(intervals: Column) -> Column:
    """1 - MAD/median of sorted intervals, within [0, 1]; 0 for fewer than two or a median of 0."""
    median = _median_sorted(intervals)
    spread = _median_sorted(F.sort_array(F.transform(intervals, lambda x: F.abs(x - median))))
    score = F.least(F.greatest(1 - spread / median, F.lit(0.0)), F.lit(1.0))
    return F.when((F.size(intervals) >= 2) & (median > 0), score).otherwise(F.lit(0.0))


def channel_regularity(conns: DataFrame, keys: list[str] = CHANNEL, capacity: int = 64) -> DataFrame:
    """Each channel's state at its end: the last `capacity` connections, their median gap and regularity.

    The rank limit is applied before the shuffle, so a hot channel ships at most
    `capacity` rows per input partition.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col("us").desc(), F.col("seq").desc())
    last = conns.select(*keys, "us", "seq").withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= capacity)
    framed = last.groupBy(*keys).agg(F.sort_array(F.collect_list("us")).alias("frame"))
    gaps = framed.withColumn("_gaps", once(frame_intervals(F.col("frame"))))
    return gaps.select(
        *keys, F.size("frame").alias("connections"), (_median_sorted(F.col("_gaps")) / SECOND).alias("median_s"),
        regularity(F.col("_gaps")).alias("regularity"),
    )


def beacon_candidates(
    conns: DataFrame, keys: list[str] = CHANNEL, *, min_connections: int = 6, min_periods: int = 5,
    max_interval_ratio: float = 4.0, min_regularity: float = 0.75, min_interval_s: float = 5.0,
    max_interval_s: float = 3600.0, capacity: int = 64,
) -> DataFrame:
    """Connections at which their channel looks like a beacon, with the measures behind it."""
    framed = trailing_frames(conns, keys, "us", "seq", capacity).filter(F.size("frame") >= min_connections)
    gaps = framed.withColumn("_gaps", once(frame_intervals(F.col("frame")))).withColumn("_median", once(_median_sorted(F.col("_gaps"))))
    span = F.element_at("frame", -1) - F.element_at("frame", 1)
    rhythmic = gaps.filter(
        F.col("_median").between(min_interval_s * SECOND, max_interval_s * SECOND)
        & (span >= F.col("_median") * min_periods)
        & (F.element_at("_gaps", -1) <= F.col("_median") * max_interval_ratio)
    )
    jitter = _median_sorted(F.sort_array(F.transform("_gaps", lambda x: F.abs(x - F.col("_median")))))
    return (
        rhythmic.withColumn("_jitter", once(jitter))
        .withColumn("regularity", F.least(F.greatest(1 - F.col("_jitter") / F.col("_median"), F.lit(0.0)), F.lit(1.0)))
        .filter(F.col("regularity") >= min_regularity)
        .withColumns({
            "connections": F.size("frame"), "median_s": F.col("_median") / SECOND,
            "jitter_s": F.col("_jitter") / SECOND, "observed_s": span / SECOND,
        })
        .drop("frame", "_gaps", "_median", "_jitter")
    )


def whole(x: Column) -> Column:
    """Rounded to an integer and written without a fraction (half to even)."""
    return F.bround(x).cast("bigint").cast("string")


def beacon_detect(
    events: DataFrame, *, excluded: tuple[str, ...] = EXCLUDED_IMAGES, cooldown_s: int = 1800,
    critical_at: float = 0.92, conns: DataFrame | None = None, **thresholds,
) -> DataFrame:
    """Channels with machine-like rhythm, at most one detection per cooldown.

    `conns` are the events' connections where they are already written; they are written here unless `numbered`.
    """
    # Frames are built over numbered times alone; what else a connection carries comes back for the alerts.
    conns = connections(events, excluded) if conns is None else conns
    conns = conns if "_row" in conns.columns else numbered(conns)
    candidates = beacon_candidates(conns.select(*CHANNEL, "us", "seq", "_row"), **thresholds)
    alerts = cooldown_filter(candidates, CHANNEL, "us", "seq", cooldown_s * SECOND)
    alerts = conns.join(alerts.drop(*CHANNEL, "us", "seq"), "_row")
    where = F.concat_ws(":", "dest_ip", "dest_port")
    evidence = F.create_map(
        F.lit("destination"), where, F.lit("connections"), F.col("connections").cast("string"),
        F.lit("median_interval_seconds"), round_exact(F.col("median_s"), 1).cast("string"),
        F.lit("jitter_seconds"), round_exact(F.col("jitter_s"), 1).cast("string"),
        F.lit("regularity"), round_exact(F.col("regularity"), 3).cast("string"),
        F.lit("observed_over_seconds"), whole(F.col("observed_s")),
    )
    return alerts.withColumns({
        "source": F.lit(1), "rule_id": F.lit(BEACON_RULE), "attack": F.lit(list(BEACON_TECHNIQUES)),
        "severity": F.when(F.col("regularity") >= critical_at, "critical").otherwise("high"),
        "title": F.concat(F.lit("Periodic outbound connection: "), F.col("process"), F.lit(" to "), where,
                          F.lit(" every ~"), whole(F.col("median_s")), F.lit("s")),
        "evidence": evidence, "matched_at": F.col("timestamp"),
    }).select(*DETECTION_COLUMNS)


# -- discovery -----------------------------------------------------------------

def discovery_classify(command_line: Column) -> Column:
    """Struct (technique, label) of the first recon signature found, else null."""
    out = None
    for technique, label, pattern in DISCOVERY_SIGNATURES:
        hit = command_line.rlike(REGEX_FLAGS + pattern)
        value = F.struct(F.lit(technique).alias("technique"), F.lit(label).alias("label"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def with_root(rows: DataFrame, roots: DataFrame, orphan: Column) -> DataFrame:
    """Add `root_guid`: the process's root, itself when unknown, `orphan` without a process."""
    rows = rows.withColumn("guid", F.coalesce(F.when(F.col("process_guid") != "", F.col("process_guid")), orphan))
    return (
        rows.join(roots.select("host", "guid", F.col("root_guid").alias("_root")), ["host", "guid"], "left")
        .withColumn("root_guid", F.coalesce("_root", "guid")).drop("_root")
    )


def recon_commands(events: DataFrame, roots: DataFrame) -> DataFrame:
    hits = (
        events.filter(F.col("event_id") == PROCESS_CREATE)
        .withColumn("technique", discovery_classify(F.col("command_line"))["technique"])
        .filter("technique IS NOT NULL")
        .withColumn("us", epoch_us(F.col("timestamp")))
    )
    return with_root(hits, roots, F.concat(F.lit("orphan:"), F.col("host")))


def _window_members(alerts: DataFrame, rows: DataFrame, keys: list[str], window_us: int, columns: list[str]) -> DataFrame:
    """Rows of the same key inside each alert's trailing window, joined on key and time cell."""
    cell = F.expr(f"(us - pmod(us, {window_us}L)) div {window_us}L")
    probes = alerts.select(*keys, F.col("us").alias("_at"), F.col("seq").alias("_by")).withColumn(
        "_cell", F.explode(F.array(F.expr(f"(_at - pmod(_at, {window_us}L)) div {window_us}L - 1"),
                                   F.expr(f"(_at - pmod(_at, {window_us}L)) div {window_us}L")))
    )
    joined = probes.join(rows.select(*keys, "us", "seq", *columns).withColumn("_cell", cell), [*keys, "_cell"])
    before = (F.col("us") < F.col("_at")) | ((F.col("us") == F.col("_at")) & (F.col("seq") <= F.col("_by")))
    return joined.filter((F.col("us") >= F.col("_at") - window_us) & before)


def discovery_candidates(
    recon: DataFrame, keys: list[str], *, item: str = "technique", min_distinct: int = 4, window_s: int = 300
) -> DataFrame:
    """Recon commands at which `min_distinct` kinds are live in the trailing window (adds `distinct_items`)."""
    counted = active_breadth(recon, keys, {"distinct_items": item}, "us", "seq", window_s * SECOND)
    return counted.filter(F.col("distinct_items") >= min_distinct)


def discovery_burst(
    events: DataFrame, roots: DataFrame, *, min_distinct: int = 4, window_s: int = 300, cooldown_s: int = 900,
    high_at: int = 5, sample: int = 8,
) -> DataFrame:
    """Process trees running many kinds of recon within the window, at most one detection per cooldown."""
    keys, window_us = ["host", "root_guid"], window_s * SECOND
    # Few events are recon; written once, they are read by each step below.
    recon = checkpointed(recon_commands(events, roots))
    candidates = discovery_candidates(recon, keys, min_distinct=min_distinct, window_s=window_s)
    alerts = cooldown_filter(candidates, keys, "us", "seq", cooldown_s * SECOND)
    # A technique's first sighting and example come from the start of its gap session.
    sessions = checkpointed(gap_sessions(recon, [*keys, "technique"], "us", window_us))
    examples = sessions.groupBy(*keys, "technique", "session_start").agg(
        F.min_by("command_line", F.struct("us", "seq")).alias("example"),
        F.min(F.when(F.col("us") == F.col("session_start"), F.col("seq"))).alias("_opened"),
    )
    members = (
        _window_members(alerts, sessions, keys, window_us, ["technique", "session_start"])
        .groupBy(*keys, "_at", "_by", "technique", "session_start").agg(F.max("us").alias("_last"))
        .join(examples, [*keys, "technique", "session_start"])
    )
    # At most one live session per technique, so these lists are as short as the signature table.
    bursts = members.groupBy(*keys, F.col("_at").alias("us"), F.col("_by").alias("seq")).agg(
        F.sort_array(F.collect_set("technique")).alias("attack"),
        (F.max("_last") - F.min("session_start")).alias("_span"),
        F.sort_array(F.collect_list(F.struct("session_start", "_opened", "example"))).alias("_ex"),
    )
    span = whole(F.col("_span") / SECOND)
    count = F.size("attack")
    return (
        recon.join(bursts, [*keys, "us", "seq"])
        .withColumns({
            "source": F.lit(2), "rule_id": F.lit(DISCOVERY_RULE),
            "severity": F.when(count >= high_at, "high").otherwise("medium"),
            "title": F.concat(F.lit("Reconnaissance burst: "), count.cast("string"),
                              F.lit(" distinct discovery techniques in "), span, F.lit("s")),
            "evidence": F.create_map(
                F.lit("distinct_techniques"), count.cast("string"), F.lit("techniques"), F.to_json("attack"),
                F.lit("span_seconds"), span,
                F.lit("commands"), F.to_json(F.transform(F.slice("_ex", 1, sample), lambda e: e["example"])),
            ),
            "matched_at": F.col("timestamp"), "command_line": F.lit(None).cast("string"),
        })
        .select(*DETECTION_COLUMNS)
    )


# -- scan ----------------------------------------------------------------------

def scan_candidates(
    conns: DataFrame, keys: list[str], *, min_ips: int = 10, min_ports: int = 15, window_s: int = 300
) -> DataFrame:
    """Connections at which the process has touched enough distinct addresses or ports in the window."""
    counted = active_breadth(conns, keys, {"distinct_ips": "dest_ip", "distinct_ports": "dest_port"}, "us", "seq",
                             window_s * SECOND)
    return counted.filter((F.col("distinct_ips") >= min_ips) | (F.col("distinct_ports") >= min_ports))


def scan_detect(
    events: DataFrame, *, min_ips: int = 10, min_ports: int = 15, window_s: int = 300, cooldown_s: int = 900,
    excluded: tuple[str, ...] = EXCLUDED_IMAGES, sample: int = 10, conns: DataFrame | None = None,
) -> DataFrame:
    """Processes fanning out to many destinations, at most one detection per cooldown.

    `conns` are the events' connections where they are already written.
    """
    keys, window_us = ["host", "process", "guid"], window_s * SECOND
    conns = (connections(events, excluded) if conns is None else conns).withColumn(
        "guid", F.coalesce(F.when(F.col("process_guid") != "", F.col("process_guid")), F.concat(F.lit("orphan:"), F.col("host")))
    )
    touched = checkpointed(conns.select(*keys, "us", "seq", "dest_ip", "dest_port"))
    candidates = scan_candidates(touched, keys, min_ips=min_ips, min_ports=min_ports, window_s=window_s)
    alerts = cooldown_filter(candidates, keys, "us", "seq", cooldown_s * SECOND)
    at = [*keys, "_at", "_by"]
    pairs = checkpointed(
        _window_members(alerts, touched, keys, window_us, ["dest_ip", "dest_port"])
        .groupBy(*at, "dest_ip", "dest_port").agg(F.max("us").alias("_last"))
        .withColumn("_dest", F.concat_ws(":", "dest_ip", "dest_port"))
    )
    totals = pairs.groupBy(*at).agg(F.count("*").alias("_pairs"), (F.max("_last") - F.min("_last")).alias("_span"))
    # The rank limit runs before the shuffle: a wide scan ships `sample` rows per partition, not its whole fan-out.
    first_n = Window.partitionBy(*at).orderBy("_dest")
    samples = (
        pairs.withColumn("_n", F.row_number().over(first_n)).filter(F.col("_n") <= sample)
        .groupBy(*at).agg(F.sort_array(F.collect_list("_dest")).alias("_sample"))
    )
    described = totals.join(samples, at).withColumnsRenamed({"_at": "us", "_by": "seq"}).join(alerts, [*keys, "us", "seq"])
    ips, ports = F.col("distinct_ips"), F.col("distinct_ports")
    sweep, port_scan = ips >= min_ips, ports >= min_ports
    shape = F.when(sweep & port_scan, "network scan").when(sweep, "host sweep").otherwise("port scan")
    span = whole(F.col("_span") / SECOND)
    return (
        conns.join(described, [*keys, "us", "seq"])
        .withColumns({
            "source": F.lit(3), "rule_id": F.lit(SCAN_RULE),
            "attack": F.when(sweep, F.lit([SCAN_TECHNIQUE, SWEEP_TECHNIQUE])).otherwise(F.lit([SCAN_TECHNIQUE])),
            "severity": F.when((ips >= 2 * min_ips) | (ports >= 2 * min_ports), "critical").otherwise("high"),
            "title": F.concat(F.lit("Network "), shape, F.lit(": "), F.col("process"), F.lit(" reached "),
                              ips.cast("string"), F.lit(" distinct host(s) and "), ports.cast("string"),
                              F.lit(" distinct port(s) in "), span, F.lit("s")),
            "evidence": F.create_map(
                F.lit("distinct_ips"), ips.cast("string"), F.lit("distinct_ports"), ports.cast("string"),
                F.lit("distinct_pairs"), F.col("_pairs").cast("string"), F.lit("span_seconds"), span,
                F.lit("sample_destinations"), F.to_json("_sample"), F.lit("image"), F.col("process"),
            ),
            "matched_at": F.col("timestamp"),
        })
        .select(*DETECTION_COLUMNS)
    )
