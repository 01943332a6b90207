"""Seconds per headline query on the folder in BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from emberwatch import build_session
from emberwatch.plans.queries import REGISTRY, Data

HEADLINE = (
    "normalize_events", "match_rules", "process_nodes", "ancestry", "correlate_incidents", "beacon_detect",
    "discovery_burst", "scan_detect", "regularity", "cooldown_filter", "indicators", "behavior_profile", "noise_join",
    "search_incidents", "top_rules", "cumulative_histogram", "stix_objects", "base64_runs", "stream_match_rules",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    Data(spark, sf_dir).table("events").count()  # start the session's machinery before timing
    seconds = {}
    for name in names:
        began = time.perf_counter()
        REGISTRY[name][0](Data(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
