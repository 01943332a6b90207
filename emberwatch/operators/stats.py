"""Dashboard statistics, counters, queues and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.functions.scalars import utc_day
from emberwatch.model import HISTOGRAM_BOUNDS, SEVERITIES


def one_row(*aggregates: DataFrame) -> DataFrame:
    """Several one-row aggregates as one row."""
    out = aggregates[0]
    for frame in aggregates[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def stats_totals(incidents: DataFrame, detections: DataFrame) -> DataFrame:
    status = F.coalesce("status", F.lit("open"))
    totals = incidents.agg(
        F.count("*").alias("incidents"), F.count_if(status == "open").alias("open"),
        F.count_if((status == "open") & F.col("actionable")).alias("actionable_open"),
        F.count_if(status == "closed").alias("closed"), F.count_if(status == "false_positive").alias("false_positive"),
    )
    return one_row(totals, detections.agg(F.count("*").alias("detections")))


def incidents_per_day(incidents: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Incidents by UTC day of first_seen for the last `days` days, days without any included."""
    if days < 1:
        raise ValueError("days is 1 or more")
    spark = incidents.sparkSession
    last = utc_day(as_of)
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    counts = incidents.groupBy(utc_day(F.col("first_seen")).alias("day")).agg(F.count("*").alias("_n"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("_n", F.lit(0)).alias("incidents"))


def severity_distribution(rows: DataFrame) -> DataFrame:
    scale = rows.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counts = rows.groupBy("severity").agg(F.count("*").alias("_n"))
    return scale.join(counts, "severity", "left").select("severity", F.coalesce("_n", F.lit(0)).alias("rows"))


def top_rules(detections: DataFrame, n: int = 10) -> DataFrame:
    """Rules by detections, most first, with the title first seen."""
    order = F.struct("matched_at", "seq", "source")
    return (
        detections.groupBy("rule_id").agg(F.count("*").alias("detections"), F.min_by("title", order).alias("title"))
        .orderBy(F.col("detections").desc(), "rule_id").limit(n)
    )


def top_techniques(detections: DataFrame, catalogue: DataFrame | None = None, n: int = 10) -> DataFrame:
    """Techniques by detections, named from the catalogue, else by their id."""
    top = (
        detections.select(F.explode("attack").alias("technique")).groupBy("technique")
        .agg(F.count("*").alias("detections")).orderBy(F.col("detections").desc(), "technique").limit(n)
    )
    if catalogue is None:
        return top.withColumn("name", F.col("technique"))
    names = catalogue.select(F.col("id").alias("technique"), F.col("name").alias("_name"))
    return top.join(names, "technique", "left").select("technique", "detections", F.coalesce("_name", "technique").alias("name"))


def labelled_counter(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("total"))


def cumulative_histogram(
    rows: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float] = HISTOGRAM_BOUNDS
) -> DataFrame:
    """Per label set and boundary: how many values lie at or below it; `+Inf`, sum and count besides."""
    counted = rows.groupBy(*labels).agg(
        F.array(*[F.count_if(F.col(value) <= b) for b in bounds]).alias("_c"), F.sum(value).alias("value_sum"),
        F.count(value).alias("value_count"),
    )
    steps = [F.struct(F.lit(str(b)).alias("le"), F.get("_c", F.lit(i)).alias("at_or_below")) for i, b in enumerate(bounds)]
    steps.append(F.struct(F.lit("+Inf").alias("le"), F.col("value_count").alias("at_or_below")))
    return counted.select(*labels, F.inline(F.array(*steps)), "value_sum", "value_count")


def replay_summary(members: DataFrame) -> DataFrame:
    """Fires and distinct incidents per rule, most fires first."""
    return (
        members.groupBy("rule_id").agg(F.count("*").alias("fires"), F.count_distinct("incident_id").alias("incidents"))
        .orderBy(F.col("fires").desc(), "rule_id")
    )


def console_counters(detections: DataFrame, n: int = 12) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hosts and techniques seen, detections by severity, top techniques)."""
    known = F.when((F.col("host") != "unknown") & (F.col("host") != ""), F.col("host"))
    hosts = detections.agg(F.count_distinct(known).alias("hosts"))
    techniques = detections.select(F.explode("attack").alias("t")).agg(F.count_distinct("t").alias("techniques"))
    return (
        one_row(hosts, techniques),
        detections.groupBy("severity").agg(F.count("*").alias("detections")),
        top_techniques(detections, n=n).drop("name"),
    )


def engine_counters(
    events: DataFrame, rules: DataFrame, nodes: DataFrame, open_incidents: DataFrame, channels: DataFrame,
    bursts: DataFrame, scans: DataFrame,
) -> DataFrame:
    """(counter, total) rows: what the engine has seen and is watching."""
    frames = {
        "events_seen": events, "rules_loaded": rules, "processes_tracked": nodes, "open_incidents": open_incidents,
        "channels_watched": channels, "bursts_watched": bursts, "scans_watched": scans,
    }
    out = None
    for name, frame in frames.items():
        row = frame.agg(F.count("*").alias("total")).select(F.lit(name).alias("counter"), "total")
        out = row if out is None else out.unionByName(row)
    return out


# -- queues ----------------------------------------------------------------------

def latest_detections(detections: DataFrame, n: int) -> DataFrame:
    """Newest `n`, handed back oldest first."""
    newest = [F.col(c).desc() for c in ("matched_at", "seq", "source", "rule_id")]
    return detections.orderBy(*newest).limit(n).orderBy("matched_at", "seq", "source", "rule_id")


def latest_incidents(incidents: DataFrame, n: int, actionable_only: bool = False) -> DataFrame:
    rows = incidents.filter("actionable") if actionable_only else incidents
    return rows.orderBy(F.col("last_seen").desc(), "id").limit(n)


def incidents_by_status(incidents: DataFrame, status: str, n: int | None = None) -> DataFrame:
    """Incidents of one status, newest first; all of them unless `n` is given."""
    rows = incidents.filter(F.coalesce("status", F.lit("open")) == status).orderBy(F.col("last_seen").desc(), "id")
    return rows if n is None else rows.limit(n)


def triage_queue(incidents: DataFrame, scope: str = "triage") -> DataFrame:
    """Scopes: triage (actionable, unresolved), closed (resolved), all (unresolved); newest first."""
    resolved = F.coalesce("status", F.lit("open")).isin("closed", "false_positive")
    scopes = {"triage": F.col("actionable") & ~resolved, "closed": resolved, "all": ~resolved}
    return incidents.filter(scopes[scope]).orderBy(F.col("last_seen").desc(), "id")
