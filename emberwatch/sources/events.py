"""Event intake: JSON lines, converted event-log records, size and shape checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberwatch.model import MAX_EVENT_BYTES, SYSMON_CHANNEL


def read_events_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON event per line: (value, is_valid). Blank lines are left out; bad ones are flagged, not lost."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.withColumn("is_valid", F.try_parse_json("value").isNotNull())


def intake_outcome(value: Column, max_bytes: int = MAX_EVENT_BYTES) -> Column:
    is_object = F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT<")
    return (
        F.when(F.octet_length(value) > max_bytes, F.lit("oversize"))
        .when(~F.coalesce(is_object, F.lit(False)), F.lit("malformed"))
        .otherwise(F.lit("accepted"))
    )


def intake_split(payloads: DataFrame, *, payload: str = "value", max_bytes: int = MAX_EVENT_BYTES) -> DataFrame:
    """Add `outcome`: accepted, oversize or malformed (not a JSON object)."""
    return payloads.withColumn("outcome", intake_outcome(F.col(payload), max_bytes))


def intake_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("outcome").agg(F.count("*").alias("payloads"))


#: Objects and lists inside each other that are searched for text nodes; converted event records have at most five.
TEXT_LEVELS = 6


def _lifted(v: Column, levels: int = TEXT_LEVELS) -> Column:
    kind = F.schema_of_variant(v)
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    sole = (F.size(fields) == 1) & F.map_contains_key(fields, "#text")
    text = F.try_variant_get(v, '$["#text"]', "variant")
    if not levels:
        return F.when(kind.startswith("OBJECT<") & sole, text).otherwise(v)
    inside = F.to_variant_object(F.transform_values(fields, lambda _, x: _lifted(x, levels - 1)))
    items = F.to_variant_object(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _lifted(x, levels - 1)))
    return F.when(kind.startswith("OBJECT<"), F.when(sole, text).otherwise(inside)).when(kind.startswith("ARRAY<"), items).otherwise(v)


def lift_text_nodes(json_text: Column) -> Column:
    """Replace each object whose only key is `#text` by that value, whatever it is; what is lifted is not searched again.

    Keys come out in order of name. Text that is no JSON stays as it is, also text nested too deeply to be parsed and
    text with a repeated key. An escaped lone surrogate is read as "?".
    """
    return F.coalesce(F.to_json(_lifted(F.try_parse_json(json_text))), json_text)


def evtx_json_to_payload(records: DataFrame, *, record: str = "value") -> DataFrame:
    """Event-log records already converted from XML to JSON -> (channel, value) in the enveloped shape.

    A record that cannot be parsed is left out, as is one whose data is neither an object nor absent.
    """
    parsed = records.withColumn("_r", F.try_parse_json(F.col(record))).filter("_r IS NOT NULL")
    lifted = lambda part: _lifted(F.try_variant_get("_r", f"$.Event.{part}", "variant"))
    parsed = parsed.withColumn("_s", lifted("System")).withColumn("_d", lifted("EventData"))
    read = lambda path: F.try_variant_get(F.col("_s"), path, "string")
    is_object = F.schema_of_variant("_d").startswith("OBJECT<")
    absent = F.col("_d").isNull() | (F.schema_of_variant("_d") == "VOID")
    event_id = F.coalesce(
        F.try_variant_get("_s", '$.EventID["#text"]', "int"), F.try_variant_get("_s", "$.EventID", "int"), F.lit(0)
    )
    payload = F.to_json(F.struct(
        F.struct(
            event_id.alias("event_id"),
            F.coalesce(read("$.Computer"), F.lit("unknown")).alias("computer_name"),
            F.when(is_object, F.col("_d")).alias("event_data"),
        ).alias("winlog"),
        read('$.TimeCreated["#attributes"].SystemTime').alias("@timestamp"),
    ))
    return (
        parsed.filter(F.coalesce(is_object, F.lit(False)) | absent)
        .select(*[c for c in records.columns if c != record],
                F.coalesce(read("$.Channel"), F.lit("")).alias("channel"), payload.alias(record))
    )


def replay_filter(
    records: DataFrame, *, event_ids: list[int] | None = None, all_channels: bool = False, limit: int | None = None,
    channel: str = "channel", event_id: str = "event_id", seq: str = "seq",
) -> DataFrame:
    """Sysmon channel only (a record without one passes), chosen event ids, first `limit` in order."""
    out = records
    if not all_channels:
        out = out.filter(F.coalesce(F.col(channel), F.lit("")).isin("", SYSMON_CHANNEL))
    if event_ids is not None:
        out = out.filter(F.col(event_id).isin(*event_ids) if event_ids else F.lit(False))
    return out if limit is None else out.orderBy(seq).limit(limit)
