"""Detections to scored, titled incidents."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.functions.scalars import basename
from emberwatch.model import (
    ACTIONABLE_COUNT, ACTIONABLE_SCORE, CHAINS, INCIDENT_WINDOW_S, NARRATIVES, SIGNATURE_TITLES, TACTIC_LABELS,
    TITLE_TACTICS, epoch_us, score_severity, severity_weight, technique_tactic,
)
from emberwatch.operators.ordering import gap_sessions, previous_time, running_totals

SECOND = 1_000_000


def attach_tree(detections: DataFrame, chains: DataFrame) -> DataFrame:
    """Add root_guid, root_image, chain and `treed` (chain is of the tree); a detection of an unknown process stands alone.

    Without a process the key is per host and rule, and the chain falls back to
    the parent and image names on the event itself.
    """
    guid = F.coalesce(
        F.when(F.col("process_guid") != "", F.col("process_guid")),
        F.concat_ws(":", F.lit("orphan"), F.col("host"), F.col("rule_id")),
    )
    fallback = F.array_compact(F.array(basename(F.col("parent_image")), basename(F.col("image"))))
    known = chains.select("host", "guid", F.col("root_guid").alias("_root"), F.col("root_image").alias("_image"),
                          F.col("chain").alias("_chain"))
    return (
        detections.withColumn("guid", guid).join(known, ["host", "guid"], "left")
        .withColumns({
            "root_guid": F.coalesce("_root", "guid"),
            "root_image": F.when(F.col("_root").isNotNull(), F.col("_image")).otherwise(F.col("parent_image")),
            "chain": F.coalesce("_chain", fallback), "treed": F.col("_chain").isNotNull(),
        })
        .drop("_root", "_image", "_chain", "guid")
    )


def incident_id(host: Column, root: Column, start_us: Column) -> Column:
    return F.concat_ws("/", host, root, start_us.cast("string"))


def assign_incidents(rooted: DataFrame, window_s: int = INCIDENT_WINDOW_S) -> DataFrame:
    """Add `incident_id`: per (host, root), a gap of more than the window opens a new incident."""
    keys = ["host", "root_guid"]
    timed = rooted.withColumn("us", epoch_us(F.col("matched_at")))
    sessions = gap_sessions(timed, keys, "us", window_s * SECOND)
    return sessions.withColumn("incident_id", incident_id(F.col("host"), F.col("root_guid"), F.col("session_start")))


def correlation_chain(rule_ids: Column) -> Column:
    """Struct (name, title) of the first chain whose every requirement holds, else null."""
    out = None
    for name, title, needs in CHAINS:
        holds = reduce(and_, [F.size(F.array_intersect(rule_ids, F.lit(list(ids)))) >= n for n, ids in needs])
        value = F.struct(F.lit(name).alias("name"), F.lit(title).alias("title"))
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return out


def incident_title(host: Column, rule_ids: Column, techniques: Column) -> Column:
    """Chain title, narrative, signature rule, alphabetically first tactic, in that order."""
    tactics = F.array_distinct(F.array_compact(F.transform(techniques, lambda t: technique_tactic(t, TITLE_TACTICS))))
    story = None
    for needed, title in NARRATIVES:
        test = F.size(F.array_except(F.lit(list(needed)), tactics)) == 0
        story = F.when(test, title) if story is None else story.when(test, title)
    signature = None
    for rule, title in SIGNATURE_TITLES:
        test = F.array_contains(rule_ids, rule)
        signature = F.when(test, title) if signature is None else signature.when(test, title)
    labels = F.create_map(*[F.lit(x) for kv in TACTIC_LABELS.items() for x in kv])
    label = labels[F.array_min(tactics)]
    base = F.coalesce(correlation_chain(rule_ids)["title"], story, signature, label, F.lit("Suspicious activity"))
    return F.concat(base, F.lit(" on "), host)


def is_actionable(score: Column, has_critical: Column, count: Column) -> Column:
    return (score >= ACTIONABLE_SCORE) | has_critical | (count >= ACTIONABLE_COUNT)


def correlate_incidents(members: DataFrame) -> DataFrame:
    """Incident aggregates of detections that carry `incident_id`.

    Every aggregate merges map-side, so an incident with very many detections
    arrives at its reducer as one partial row per input partition.
    """
    order = F.struct("us", "seq", "source", "rule_id")
    grouped = members.groupBy("incident_id", "host", "root_guid").agg(
        F.min_by("root_image", order).alias("root_image"),
        F.sum(severity_weight(F.col("severity"))).alias("score"),
        F.count("*").alias("detection_count"),
        F.max((F.col("severity") == "critical").cast("int")).alias("_critical"),
        F.min_by("chain", order).alias("_opening"),
        F.min_by(F.when(F.col("treed"), F.col("chain")), F.struct(~F.col("treed"), -F.size("chain"), order)).alias("_tree"),
        F.sort_array(F.collect_set("rule_id")).alias("rule_ids"),
        F.flatten(F.collect_set("attack")).alias("_attack"),
        F.min("matched_at").alias("first_seen"), F.max("matched_at").alias("last_seen"),
    )
    techniques = F.array_sort(F.array_distinct("_attack"))
    # The opening detection's chain, fallback or not, unless a later one has a longer chain in the tree.
    chain = F.when(F.size("_tree") > F.size("_opening"), F.col("_tree")).otherwise(F.col("_opening"))
    return (
        grouped.withColumn("techniques", techniques).withColumn("chain", chain)
        .withColumns({
            "severity": score_severity(F.col("score")),
            "actionable": is_actionable(F.col("score"), F.col("_critical") == 1, F.col("detection_count")),
            "classification": correlation_chain(F.col("rule_ids"))["name"],
            "title": incident_title(F.col("host"), F.col("rule_ids"), F.col("techniques")),
        })
        .drop("_critical", "_attack", "_opening", "_tree")
        .withColumnRenamed("incident_id", "id")
    )


def incident_sweep(incidents: DataFrame, as_of: Column, window_s: int = INCIDENT_WINDOW_S) -> DataFrame:
    """Add `closed`: idle for longer than the window at `as_of`."""
    return incidents.withColumn("closed", epoch_us(as_of) - epoch_us(F.col("last_seen")) > window_s * SECOND)


def running_last_seen(members: DataFrame) -> DataFrame:
    """Add the incident's last_seen and detection ordinal as of each member."""
    counted = running_totals(members.withColumn("_one", F.lit(1)), ["incident_id"], "us", ["seq", "source", "rule_id"],
                             {"ordinal": "_one"})
    # Members are taken in time order, so the latest time so far is the member's own.
    return counted.drop("_one").withColumn("last_seen", F.timestamp_micros("us"))


def timeline_gaps(members: DataFrame) -> DataFrame:
    """Add `gap_s`, the seconds since the incident's previous detection."""
    return previous_time(members, ["incident_id"], "us", ["seq", "source", "rule_id"]).withColumn(
        "gap_s", (F.col("us") - F.col("previous_us")) / SECOND
    ).drop("previous_us")


def detections_for_incident(members: DataFrame, incident: str) -> DataFrame:
    return members.filter(F.col("incident_id") == incident).orderBy("us", "seq", "source", "rule_id")


def detection_incident_join(members: DataFrame, incidents: DataFrame) -> DataFrame:
    facts = incidents.select(F.col("id").alias("incident_id"), F.col("title").alias("incident_title"),
                             F.col("severity").alias("incident_severity"))
    return members.join(facts, "incident_id")


def rule_ids_by_incident(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Distinct rule ids of the incidents named in `wanted` (column `incident_id`)."""
    return (
        members.select("incident_id", "rule_id").join(wanted.select("incident_id"), "incident_id", "left_semi")
        .groupBy("incident_id").agg(F.sort_array(F.collect_set("rule_id")).alias("rule_ids"))
    )
