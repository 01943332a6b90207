"""Stored tables: detections, incidents, analyst triage and reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.functions.scalars import note_accepted, worst_verdict
from emberwatch.model import STATUSES, epoch_us


def detections_sink(detections: DataFrame, path: str, mode: str = "append") -> None:
    """Append detections, the original payload included, partitioned by day."""
    detections.withColumn("day", F.to_date("matched_at")).write.mode(mode).partitionBy("day").parquet(path)


def incidents_upsert(current: DataFrame, changed: DataFrame) -> DataFrame:
    """The engine-owned incident table after an upsert by id: new values win, `first_seen` stays as first written.

    Analyst status and notes live in the triage log, so nothing here can touch them.
    """
    kept = current.join(changed.select("id"), "id", "left_anti")
    first = current.select("id", F.col("first_seen").alias("_first"))
    updated = changed.join(first, "id", "left").withColumn("first_seen", F.coalesce("_first", "first_seen")).drop("_first")
    return kept.unionByName(updated)


def _known_status() -> Column:
    return F.coalesce(F.lower("status").isin(*STATUSES), F.lit(False))


def triage_refused(log: DataFrame) -> DataFrame:
    """Rows of a triage log of which triage_overlay does not take all, with `refused`: 'status', 'notes' or both.

    A status or note that is not given is not refused.
    """
    refused = F.array_compact(F.array(
        F.when(F.col("status").isNotNull() & ~_known_status(), "status"),
        F.when(F.col("notes").isNotNull() & ~note_accepted(F.col("notes")), "notes")))
    return log.withColumn("refused", refused).filter(F.size("refused") > 0)


def triage_overlay(incidents: DataFrame, log: DataFrame) -> DataFrame:
    """Incidents with analyst state from a triage log (incident_id, changed_at, seq, status, notes).

    The latest accepted status and the latest accepted note win separately; notes
    over the word limit and unknown statuses are refused (see triage_refused). Defaults: open, no note.
    """
    order = F.struct("changed_at", "seq")
    status = F.lower("status")
    valid = _known_status()
    noted = F.coalesce(F.col("notes").isNotNull() & note_accepted(F.col("notes")), F.lit(False))
    latest = log.groupBy("incident_id").agg(
        F.max_by(status, F.when(valid, order)).alias("status"), F.max_by("notes", F.when(noted, order)).alias("notes"),
    )
    base = incidents.drop("status", "notes")
    return base.join(latest, base["id"] == latest["incident_id"], "left").drop("incident_id").withColumns(
        {"status": F.coalesce("status", F.lit("open")), "notes": F.coalesce("notes", F.lit(""))})


def reputation_join(indicators: DataFrame, reputation: DataFrame, *, indicator: str = "value") -> DataFrame:
    """Add `verdict`: the worst of the available providers' verdicts (indicator, provider, verdict, available)."""
    worst = reputation.groupBy("indicator").agg(
        worst_verdict(F.col("verdict"), F.col("available")).alias("_verdict"))
    return indicators.join(worst, indicators[indicator] == worst["indicator"], "left").drop("indicator").withColumn(
        "verdict", F.coalesce("_verdict", F.lit("unknown"))).drop("_verdict")


def reputation_ttl(results: DataFrame, as_of: Column, ttl_s: int = 3600) -> DataFrame:
    """Latest result per (indicator, provider), if still younger than the time to live."""
    latest = results.groupBy("indicator", "provider").agg(
        F.max_by(F.struct("verdict", "available"), "fetched_at").alias("_r"), F.max("fetched_at").alias("fetched_at"))
    return latest.filter(epoch_us(as_of) - epoch_us(F.col("fetched_at")) < ttl_s * 1_000_000).select(
        "indicator", "provider", "_r.verdict", "_r.available", "fetched_at")
