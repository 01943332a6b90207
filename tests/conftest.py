import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberwatch import build_session  # noqa: E402
from emberwatch.model import EVENT_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


BASE = 1_783_850_400  # 2026-07-12 10:00:00 UTC


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from dicts; `at` is seconds after the base clock, other upper-case keys are raw fields."""
    from datetime import datetime, timezone

    names = [f.name for f in EVENT_SCHEMA.fields]

    def build(rows):
        out = []
        for i, row in enumerate(rows):
            row = dict(row)
            at = datetime.fromtimestamp(BASE + row.pop("at", i), timezone.utc)
            raw = {k: v for k, v in row.items() if k[0].isupper()}
            full = {"seq": i, "event_uid": f"e{i}", "timestamp": at, "host": "H", "event_id": 1, "raw": raw,
                    **{k: v for k, v in row.items() if not k[0].isupper()}}
            out.append(tuple(full.get(n) for n in names))
        return spark.createDataFrame(out, EVENT_SCHEMA)

    return build
