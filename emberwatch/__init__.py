"""Telemetry detection and correlation on Spark DataFrames."""

from emberwatch.session import build_session, checkpointed, load_table

__all__ = ["build_session", "checkpointed", "load_table"]
