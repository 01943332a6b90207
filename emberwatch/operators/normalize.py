"""Any of three JSON envelopes to the typed event schema."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.model import EVENT_SCHEMA, PROMOTION_ORDER

# JSON texts that count as absent.
FALSY = ("null", "false", "0", "0.0", "", "{}", "[]", '""')


def _get(v: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f'$["{key}"]', kind)


def _truthy(v: Column) -> Column:
    return F.when(~v.cast("string").isin(*FALSY), v)


def parse_event_ts(text: Column, fallback: Column) -> Column:
    """ISO time with `Z`, an offset or none (taken as UTC); bad or missing gives `fallback`."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(F.trim(text), "^(\\S+) (\\S+)$", "$1T$2")), fallback)


def parse_event_id(*candidates: Column) -> Column:
    """First candidate that is present and non-zero, as an integer; otherwise 0."""
    first = F.coalesce(*[F.when(~c.isin("", "0", "null", "false"), c) for c in candidates])
    return F.coalesce(F.trim(first).try_cast("int"), F.lit(0))


def extract_host(payload: Column, winlog: Column, data: Column) -> Column:
    host = _get(payload, "host", "variant")
    named = F.try_variant_get(host, "$.name", "string")
    plain = F.when(F.schema_of_variant(host) == "STRING", host.cast("string"))
    blank_is_null = lambda c: F.when(~c.isin("", "0", "false"), c)
    return F.coalesce(
        blank_is_null(named), blank_is_null(_get(winlog, "computer_name")), blank_is_null(plain),
        blank_is_null(data["Computer"]), F.lit("unknown"),
    )


def promote_fields(data: Column) -> dict[str, Column]:
    """Promoted attributes from a payload map: nulls are skipped, empty strings kept."""
    out = {target: F.coalesce(*[data[k] for k in keys]) for target, keys in PROMOTION_ORDER.items()}
    out["process_id"] = F.trim(out["process_id"]).try_cast("int")
    return out


def normalize_events(payloads: DataFrame, *, payload: str = "value", seq: str = "seq",
                     received: str = "received_at") -> DataFrame:
    """Typed events from JSON objects held as text in `payload`.

    `received` stands in for a missing or unreadable event time, so a replay
    gives the same rows as the first run.
    """
    v = F.col("_v")
    parsed = payloads.select(
        F.col(seq).alias("_seq"), F.col(received).alias("_received"), F.try_parse_json(F.col(payload)).alias("_v")
    )
    opened = parsed.withColumn("_w", F.coalesce(_truthy(_get(v, "winlog", "variant")), v))
    promoted_keys = [k for keys in PROMOTION_ORDER.values() for k in keys]
    opened = opened.withColumn("_inner", _truthy(_get(F.col("_w"), "event_data", "variant"))).withColumn(
        "_flat",
        F.col("_inner").isNull()
        & reduce(or_, [_get(v, k, "variant").isNotNull() for k in promoted_keys]),
    )
    source = F.when(F.col("_flat"), v).otherwise(F.col("_inner"))
    mapped = opened.withColumn(
        "_data", F.coalesce(F.try_variant_get(source, "$", "map<string,string>"), F.create_map().cast("map<string,string>"))
    )
    data = F.col("_data")
    columns = {
        "seq": F.col("_seq"), "event_uid": F.concat(F.lit("e"), F.col("_seq")),
        "event_id": parse_event_id(_get(F.col("_w"), "event_id"), _get(v, "EventID"), data["EventID"]),
        "timestamp": parse_event_ts(
            F.coalesce(F.nullif(_get(v, "@timestamp"), F.lit("")), data["UtcTime"]), F.col("_received")
        ),
        "host": extract_host(v, F.col("_w"), data), "raw": data, **promote_fields(data),
    }
    return mapped.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields])
