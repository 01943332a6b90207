"""Rules as data, compiled to predicates and evaluated in one scan."""

from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from emberwatch.functions.predicates import field_ref, field_sql, folded_ref, sql_text
from emberwatch.model import DETECTION_COLUMNS, SEVERITIES, epoch_us
from emberwatch.rules.catalogue import RULES


SEPARATOR = "\x1f"


@dataclass(frozen=True)
class Rule:
    id: str
    event_id: int
    severity: str
    title: str
    detection: dict[str, Any]
    attack: tuple[str, ...] = ()
    condition: str = "all"
    description: str = ""
    enabled: bool = True
    extra: dict[str, Any] = field(default_factory=dict, compare=False)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> "Rule":
        severity = str(data.get("severity", "medium")).lower()
        if severity not in SEVERITIES:
            raise ValueError(f"rule {data.get('id')}: unknown severity {severity!r}")
        return cls(
            id=str(data["id"]), event_id=int(data["event_id"]), severity=severity, title=str(data["title"]),
            detection=dict(data.get("detection") or {}), attack=tuple(data.get("attack") or ()),
            condition=str(data.get("condition", "all")), description=str(data.get("description", "")),
            enabled=bool(data.get("enabled", True)),
        )

    def test_sql(self, lowered: dict[str, str] | None = None, folded: dict[str, str] | None = None) -> str:
        """Field tests only; `condition` other than `all` means any, and no test at all never holds."""
        glue = " AND " if self.condition == "all" else " OR "
        return glue.join(field_sql(spec, value, lowered, folded) for spec, value in self.detection.items()) or "false"

    def test(self) -> Column:
        return F.expr(self.test_sql())


def shipped_rules() -> list[Rule]:
    return [
        Rule(id=rid, event_id=code, severity=sev, condition=cond, attack=attack, title=title,
             detection=detection)
        for rid, code, sev, cond, attack, title, detection in RULES
    ]


def read_rules(folder: str) -> list[Rule]:
    """Rules from JSON or YAML files under a folder; malformed or disabled ones are left out."""
    try:
        import yaml
    except ImportError:
        yaml = None
    rules = []
    for root, _, names in sorted(os.walk(folder)):
        for name in sorted(names):
            path = os.path.join(root, name)
            is_yaml = name.endswith((".yml", ".yaml"))
            if not (name.endswith(".json") or is_yaml and yaml):
                continue
            try:
                with open(path, encoding="utf-8") as handle:
                    data = yaml.safe_load(handle) if is_yaml else json.load(handle)
                rule = Rule.from_dict(data)
            except (ValueError, KeyError, TypeError, OSError) + ((yaml.YAMLError,) if yaml else ()):
                continue
            if rule.enabled:
                rules.append(rule)
    return rules


RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType()), T.StructField("event_id", T.IntegerType()),
    T.StructField("title", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("attack", T.ArrayType(T.StringType())),
])


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rule metadata as literal rows, whose size the planner knows when it weighs a broadcast."""
    rows = [
        f"({sql_text(r.id)}, {r.event_id}, {sql_text(r.title)}, {sql_text(r.severity)}, "
        f"CAST(array({', '.join(sql_text(t) for t in r.attack)}) AS array<string>))"
        for r in rules
    ]
    if not rows:
        return spark.createDataFrame([], RULE_SCHEMA)
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS r(rule_id, event_id, title, severity, attack)")


def _text_columns(rules: list[Rule]) -> tuple[dict[str, str], dict[str, str], dict[str, Column]]:
    """Helper columns: lower-case text per field compared, folded text per field searched, and their definitions.

    Each is filled only for the event codes whose rules read the field.
    """
    codes: dict[tuple[str, str], set[int]] = defaultdict(set)
    for rule in rules:
        for spec in rule.detection:
            name, *modifiers = spec.split("|")
            codes["re" if "re" in modifiers else "text", name].add(rule.event_id)
    names = {"text": {}, "re": {}}
    definitions = {}
    for i, ((kind, name), used) in enumerate(sorted(codes.items())):
        column = names[kind][name] = f"_{kind}_{i}"
        text = folded_ref(name) if kind == "re" else f"lower({field_ref(name)})"
        definitions[column] = F.expr(f"IF(event_id IN ({', '.join(map(str, sorted(used)))}), {text}, NULL)")
    return names["text"], names["re"], definitions


def matching_rule_ids(
    rules: Iterable[Rule], lowered: dict[str, str] | None = None, folded: dict[str, str] | None = None
) -> Column:
    """Ids of all rules an event fires, joined by `SEPARATOR`; only its own code's rules are evaluated.

    Two choices keep the tests in compiled code. The ids are joined as text, for
    skipping nulls in an array is a higher-order function and those interpret what
    is inside them. And the first code is tested by such a function on purpose: an
    operator that has one compiles its expressions into many small methods, where
    fusing a hundred rules into the stage's one method would pass the JVM's limit.
    """
    by_code: dict[int, list[Rule]] = defaultdict(list)
    for rule in rules:
        if rule.enabled and rule.detection:
            by_code[rule.event_id].append(rule)
    branches = [
        f"WHEN {f'exists(array(event_id), c -> c = {code})' if i == 0 else f'event_id = {code}'} THEN concat_ws('{SEPARATOR}', "
        + ", ".join(f"IF({r.test_sql(lowered, folded)}, {sql_text(r.id)}, NULL)" for r in group) + ")"
        for i, (code, group) in enumerate(sorted(by_code.items()))
    ]
    return F.expr("CASE " + " ".join(branches) + " ELSE '' END") if branches else F.lit("")


def match_rules(events: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """One detection per (event, firing rule). A single pass: no shuffle but the small metadata join."""
    rules = [r for r in rules if r.enabled]
    codes = sorted({r.event_id for r in rules})
    # Lower-case texts are computed once per event, not once per rule.
    lowered, folded, texts = _text_columns(rules)
    fired = (
        events.filter(F.col("event_id").isin(*codes) if codes else F.lit(False))
        .withColumns(texts)
        .withColumn("_fired", matching_rule_ids(rules, lowered, folded))
        .withColumn("rule_id", F.explode(F.split("_fired", SEPARATOR)))
        .filter(F.col("rule_id") != "")
    )
    meta = rules_frame(events.sparkSession, rules).drop("event_id")
    return (
        fired.join(meta, "rule_id")
        .withColumn("source", F.lit(0))
        .withColumn("evidence", F.lit(None).cast("map<string,string>"))
        .withColumn("matched_at", F.col("timestamp"))
        .select(*DETECTION_COLUMNS)
    )


def all_detections(*frames: DataFrame) -> DataFrame:
    """Union of rule and detector output; order within an event is (source, rule_id)."""
    out = frames[0].select(*DETECTION_COLUMNS)
    for frame in frames[1:]:
        out = out.unionByName(frame.select(*DETECTION_COLUMNS))
    return out


def detection_order() -> list[Column]:
    return [epoch_us(F.col("matched_at")), F.col("seq"), F.col("source"), F.col("rule_id")]


def rules_per_event_id(rules: DataFrame) -> DataFrame:
    return rules.groupBy("event_id").agg(F.count("*").alias("rules"))


def rules_not_fired(rules: DataFrame, detections: DataFrame) -> DataFrame:
    return rules.join(detections.select("rule_id").distinct(), "rule_id", "left_anti")


def event_rule_join(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events with each rule written for their code (candidates, before matching)."""
    return events.join(rules, "event_id")
