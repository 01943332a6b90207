"""End to end: events to detections to incidents."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from emberwatch.operators import detectors, incidents, matching, tree
from emberwatch.operators.matching import Rule
from emberwatch.session import checkpointed


class Detection:
    """The derived frames of one event table, each built on first use.

    All detectors run on their defaults. `settings` holds keyword arguments per
    detector: {"beacon": {...}, "discovery": {...}, "scan": {...}}; where it is
    given, a detector left out does not run.
    """

    def __init__(self, events: DataFrame, rules: Iterable[Rule] | None = None, settings: dict[str, dict] | None = None):
        self.source = events
        self.rules = list(rules) if rules is not None else matching.shipped_rules()
        self.settings = {"beacon": {}, "discovery": {}, "scan": {}} if settings is None else settings

    @cached_property
    def events(self) -> DataFrame:
        # Written once: rules, forest, connections and recon each read the columns they use, and none derives them again.
        return checkpointed(self.source)

    @cached_property
    def nodes(self) -> DataFrame:
        # Written once: the forest and every attribute lookup read nodes, not events again.
        return checkpointed(tree.process_nodes(self.events))

    @cached_property
    def paths(self) -> DataFrame:
        return tree.ancestry(self.nodes)

    @cached_property
    def roots(self) -> DataFrame:
        return checkpointed(tree.tree_root(self.nodes))

    @cached_property
    def chains(self) -> DataFrame:
        # Only trees in which something was detected need their paths. Written once: members read them twice.
        return checkpointed(tree.process_chain(tree.ancestry(tree.trees_with(self.nodes, self.roots, self.detections))))

    @cached_property
    def connections(self) -> DataFrame:
        # Written once: every step of two detectors reads them.
        return detectors.numbered(detectors.connections(self.events))

    def _connected(self, detector: str) -> dict:
        """Settings of a detector of connections, with those written here unless it excludes other images."""
        settings = self.settings[detector]
        return settings if "excluded" in settings else {**settings, "conns": self.connections}

    @cached_property
    def detections(self) -> DataFrame:
        frames = [matching.match_rules(self.events, self.rules)]
        # The detectors write their steps side by side: one that has little left to do leaves its cores to the others.
        with ThreadPoolExecutor(3) as pool:
            begin = lambda run: pool.submit(inheritable_thread_target(self.events.sparkSession)(run))
            found = []
            if "discovery" in self.settings:
                found.append(begin(lambda: detectors.discovery_burst(self.events, self.roots, **self.settings["discovery"])))
            if "beacon" in self.settings:
                connected = self._connected("beacon")
                found.append(begin(lambda: detectors.beacon_detect(self.events, **connected)))
            if "scan" in self.settings:
                reached = self._connected("scan")
                found.append(begin(lambda: detectors.scan_detect(self.events, **reached)))
            frames += [f.result() for f in found]
        # Written once: the rules scan every event, what follows reads the few that fired.
        return checkpointed(matching.all_detections(*frames))

    @cached_property
    def members(self) -> DataFrame:
        return checkpointed(incidents.assign_incidents(incidents.attach_tree(self.detections, self.chains)))

    @cached_property
    def incidents(self) -> DataFrame:
        return checkpointed(incidents.correlate_incidents(self.members))
